"""The registered query of each operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from . import decontaminate, elkan, langid, media, nbsvm, near_dup, periodic, pii, piece_lattice, secrets, toxicity, url_filter, warc


def op1_secret_scan(spark: SparkSession, base: str) -> DataFrame:
    return secrets.scan(table(spark, base, "documents"))


def op2_pii_surrogates(spark: SparkSession, base: str) -> DataFrame:
    return pii.replace(table(spark, base, "documents").select("doc_id", "text"), key="op2")


def op3_language_id(spark: SparkSession, base: str) -> DataFrame:
    return langid.identify(table(spark, base, "pages"), table(spark, base, "documents"))


def op4_warc(spark: SparkSession, base: str) -> DataFrame:
    return warc.round_trip(table(spark, base, "pages"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> m THEN m END AS refers_to
FROM f
"""


def op5_media(spark: SparkSession, base: str) -> DataFrame:
    return media.digests(table(spark, base, "documents"))


def op6_toxicity(spark: SparkSession, base: str) -> DataFrame:
    return toxicity.toxicity(table(spark, base, "documents"), table(spark, base, "labels"))


def op7_sentencepiece(spark: SparkSession, base: str) -> DataFrame:
    return piece_lattice.digests(table(spark, base, "documents"))


def op8_near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, base, "documents"), k=3, percent=85)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM w
), e AS (SELECT doc_id, unnest(s) AS t FROM s),
n AS (SELECT doc_id, len(s) AS n FROM s),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept
FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = n.doc_id
"""

def op9_decontamination(spark: SparkSession, base: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, base, "documents"), table(spark, base, "benchmark"))


def op10_quality(spark: SparkSession, base: str) -> DataFrame:
    return nbsvm.quality(table(spark, base, "documents"), table(spark, base, "labels"))


def op11_periodic_runs(spark: SparkSession, base: str) -> DataFrame:
    return periodic.digests(table(spark, base, "documents"))


# CRC-32 by its polynomial, bit by bit; equal words of a text in pairs, and islands of neighbouring pairs of one distance
OP11_SQL = r"""
WITH h AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
      lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) AS h
  FROM documents
), g AS (SELECT *, len(w) AS n, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
t AS (
  SELECT doc_id, r, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w
  FROM p
), e AS (SELECT r, n, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS i FROM t),
same AS (SELECT x.r, y.i - x.i AS q, x.i FROM e x JOIN e y ON x.r = y.r AND x.t = y.t AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM same),
stretch AS (SELECT r, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY r, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT r, start, length, min(q) AS period FROM stretch GROUP BY ALL),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(t, ' ' ORDER BY i) AS k FROM e ANTI JOIN gone USING (r, i) GROUP BY r),
described AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS b
  FROM run GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.p AS BIGINT) AS period,
  CAST(1000 * b.l // b.p AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM t LEFT JOIN described USING (r) LEFT JOIN kept USING (r)
"""


def op12_centroid_clusters(spark: SparkSession, base: str) -> DataFrame:
    return elkan.digests(table(spark, base, "embeddings"))


def _lloyd_sql(rounds: int) -> str:
    """The plain algorithm: every distance, every round."""
    parts = [
        """v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM v QUALIFY c < 40)",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS (
  SELECT r, vec_id, x.v, min({{'d': list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'c': c}}) AS b
  FROM v x CROSS JOIN c{i} c GROUP BY ALL
)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT b.c AS c, k, count(*) AS n, sum(t) AS s FROM (SELECT b, unnest(v) AS t, generate_subscripts(v, 1) AS k FROM a{i}) GROUP BY ALL),
c{i + 1} AS (
  SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS v FROM s{i} GROUP BY c) m ON m.c = o.c
)""")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(b.c AS INTEGER) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(b.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c ON c.c = b.c"""


def op13_url_filter(spark: SparkSession, base: str) -> DataFrame:
    return url_filter.verdicts(table(spark, base, "pages"))


OP13_SQL = r"""
WITH u AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), l AS (
  SELECT unnest(list_concat([url], list_transform(regexp_extract_all(coalesce(html, ''), 'href="(/[^"]*)"', 1), lambda x: 'http://' || host || x))) AS url
  FROM u WHERE regexp_matches(host, '(^|\.)(casino-win|cheap-pills|ads-track|spam-farm)\.')
), every AS (SELECT url FROM l UNION SELECT url FROM u),
form AS (
  SELECT url, lower(regexp_extract(url, '(?s)^(.*?)://', 1)) AS s, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
    regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '') AS p,
    list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS q
  FROM every WHERE contains(url, '://')
), canon AS (
  SELECT url, CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') WHEN s = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || p
    || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS c
  FROM form
), known AS (SELECT DISTINCT c FROM l JOIN canon USING (url)),
rules(verdict, rule) AS (VALUES ('allow', 'com/'), ('block', 'example.com/en/'), ('allow', 'www.example.com/en/'), ('block', 'net/es/'), ('block', 'net/fr/')),
split AS (SELECT *, regexp_extract(rule, '^[^/]*') AS rh, regexp_extract(rule, '/.*$') AS rp FROM rules),
fit AS (
  SELECT url, first({'rule': rule, 'verdict': verdict} ORDER BY len(rule) DESC) AS f
  FROM (SELECT DISTINCT url, host, path FROM u) JOIN split ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url
)
SELECT page_id, host, path, f.rule AS rule, coalesce(f.verdict, CASE WHEN k.c IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  CASE WHEN f.rule IS NULL THEN k.c IS NOT NULL END AS listed
FROM u LEFT JOIN fit USING (url) LEFT JOIN canon USING (url) LEFT JOIN known k ON k.c = canon.c
"""


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_media": op5_media,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_decontamination": op9_decontamination,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_url_filter": op13_url_filter,
}
_SQL = {
    "op4_warc": OP4_SQL,
    "op8_near_duplicates": OP8_SQL,
    "op11_periodic_runs": OP11_SQL,
    "op12_centroid_clusters": _lloyd_sql(rounds=5),
    "op13_url_filter": OP13_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
