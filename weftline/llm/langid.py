"""Language of web pages: Bayesian fusion of text, markup, address and host evidence.

For each language the posterior is in proportion to

    prior(host) * P(text) * P(declared markup language) * P(path code) * P(address suffix)

* P(text): byte trigrams of the visible text under models counted on documents
  of known language, tempered so that a long text counts as TEXT_WEIGHT trigrams.
* P(declared), P(path code), P(suffix): how often pages of each language carry
  that value; sums over all pages of the posterior from text alone, smoothed.
* prior(host): sums of the same posteriors by host, smoothed by those of its
  domain, these by the whole corpus; a page's own share is taken out first.

All sums are grouped aggregations; no group is collected, and what is joined
back has one row for each host, domain or suffix.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import arrow_map, materialize
from .textkit import U, text_bytes

BUCKETS = 1 << 16
TEXT_WEIGHT = 60.0
SMOOTH = 2.0
SAMPLE = 400
#: Languages are modelled in blocks of so many, each a table of 16 MB; a worker keeps KEPT_BLOCKS of them loaded.
LANGUAGE_BLOCK, KEPT_BLOCKS = 64, 4

_hidden = re.compile(r"<!--.*?(?:-->|$)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|$)", re.S | re.I)
_tag = re.compile(r"<[^>]*>?")
_entity = re.compile(r"&(?:[a-zA-Z]+|#x?[0-9a-fA-F]+);")
_heads = re.compile(_hidden.pattern + r"|<(html|meta)\b([^>]*)", re.S | re.I)
_declared = re.compile(r"\b(?:xml:)?lang\s*+=\s*+[\"']?\s*+([A-Za-z]{2,3})", re.I)
_meta = re.compile(r"content\s*+=\s*+[\"']?\s*+([A-Za-z]{2,3})", re.I)
_lower = np.arange(256, dtype=np.uint32)
_lower[65:91] += 32


def visible_text(html: str) -> str:
    """The text of a page without comments, scripts, styles, tags and entities."""
    return _entity.sub(" ", _tag.sub(" ", _hidden.sub(" ", html)))


def declared_language(html: str) -> str | None:
    """The primary tag of the html element's lang, else of a content-language meta element; lower-cased.

    The tags of the whole page are scanned once, those in comments, scripts and the like left out.
    """
    meta = None
    for tag in _heads.finditer(html):
        if not tag[2]:
            continue
        if tag[2].lower() == "html":
            if found := _declared.search(tag[3]):
                return found[1].lower()
        elif meta is None and (at := tag[3].lower().find("content-language")) >= 0:
            values = _meta.findall(tag[3], at)
            meta = values[-1].lower() if values else None
    return meta


def trigrams(data: np.ndarray) -> np.ndarray:
    """Hashed byte trigrams of one text, A-Z folded."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    b = _lower[data]
    code = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))).astype(np.uint64)
    return ((code * U(0x9E3779B97F4A7C15)) >> U(48)).astype(np.int64)


def train(documents: DataFrame, sample: int = SAMPLE) -> tuple[list[str], list[Broadcast]]:
    """All languages, in order, and their log trigram probabilities: a broadcast (BUCKETS, languages) table for each block.

    About ``sample`` documents of each language are counted, chosen by a hash of
    doc_id. Without labelled documents there are no languages.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("lang").cast("string")).alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and text is not null")
    counts = sorted((r[0], r[1]) for r in documents.groupBy("lang").count().collect())
    return [r[0] for r in counts], [spark.sparkContext.broadcast(_table(documents, counts[at : at + LANGUAGE_BLOCK], sample)) for at in range(0, len(counts), LANGUAGE_BLOCK)]


def _table(documents: DataFrame, counts: list[tuple[str, int]], sample: int) -> np.ndarray:
    """The log trigram probabilities of the languages in ``counts`` (language, documents)."""
    place = {r[0]: i for i, r in enumerate(counts)}
    share = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, sample / r[1]))))
    chosen = documents.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_000)) < F.lit(1_000_000) * F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def run(batches):
        total = np.zeros((len(place), BUCKETS), np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, lang in enumerate(batch.column(0).to_pylist()):
                total[place[lang]] += np.bincount(trigrams(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS)
        at, bucket = np.nonzero(total)
        for i in range(0, len(at), 100_000):
            part = slice(i, i + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(at[part], pa.int32()), pa.array(bucket[part], pa.int32()), pa.array(total[at[part], bucket[part]], pa.int64())], ["at", "bucket", "n"])

    table = np.full((BUCKETS, len(place)), 0.5)
    found = chosen.select("lang", "text").transform(arrow_map, run, "at int, bucket int, n long").groupBy("at", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table[found["bucket"].to_numpy(), found["at"].to_numpy()] += found["n"].to_numpy()
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def evidence(pages: DataFrame, names: list[str], model: list[Broadcast]) -> DataFrame:
    """(page_id, url, declared, n_text, text array<double>): what each page's html says.

    ``text`` has the tempered log likelihoods, their largest being 0; a page without text has zeros.
    """

    def run(batches):
        for batch in batches:
            declared, grams = [], []
            for i in range(batch.num_rows):
                html = batch.column(2)[i].as_py() or ""
                grams.append(trigrams(np.frombuffer(visible_text(html).encode(), np.uint8)).astype(np.uint16))
                declared.append(declared_language(html))
            sizes = [len(g) for g in grams]
            means = np.zeros((len(grams), len(names)))
            for block, shared in enumerate(model):
                own = slice(block * LANGUAGE_BLOCK, (block + 1) * LANGUAGE_BLOCK)
                for i, g in enumerate(grams):
                    if len(g):
                        means[i, own] = shared.value[g].mean(axis=0, dtype=np.float64) * min(len(g), TEXT_WEIGHT)
                if block >= KEPT_BLOCKS:
                    # loaded again from the worker's file for the next batch
                    shared.__dict__.pop("_value", None)
            values = means - means.max(axis=1, keepdims=True)
            lists = pa.array(values.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(sizes, pa.int64()), lists], ["page_id", "url", "declared", "n_text", "text"])

    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return pages.transform(arrow_map, run, "page_id long, url string, declared string, n_text long, text array<double>")


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sum_by(rows: DataFrame, key: str, names: list[str], to: str) -> DataFrame:
    """(key, to): sums of the text posteriors by a column."""
    sums = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*(F.sum(F.get("share", F.lit(i))).alias(f"s{i}") for i in range(len(names))))
    return sums.select(key, F.array(*(f"s{i}" for i in range(len(names)))).alias(to))


def identify(pages: DataFrame, documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, lang, posterior, text_lang, declared, host) for each row of ``pages`` (page_id, url, html).

    Languages are those of ``documents`` (doc_id, text, lang); without any, lang
    and text_lang are null and posterior is 0. A null or unparsable url gives no
    address and host evidence, a null or empty html none of text and markup; a
    page without any evidence gets the corpus-wide most frequent language. Of
    equal posteriors the alphabetically first language counts. Repeated rows and
    null page_ids are judged like any row; other columns play no part.
    """
    names, model = train(documents, sample)
    if not names:
        null = F.lit(None).cast("string")
        return pages.select(F.col("page_id").cast("long").alias("page_id"), null.alias("lang"), F.lit(0.0).alias("posterior"), null.alias("text_lang"), null.alias("declared"), null.alias("host"))
    known = F.array(*map(F.lit, names))
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    code = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2,3})(?:[/?#-]|$)", 1))
    listed = lambda c: F.when(F.array_contains(known, c), c).otherwise(F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise("other"))
    rows = evidence(pages, names, model)
    rows = rows.withColumns({"host": host, "code": listed(code), "markup": listed(F.col("declared"))})
    rows = rows.withColumns({"domain": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), "suffix": F.nullif(F.regexp_extract("host", r"\.([a-z]+)$", 1), F.lit(""))})
    weights = F.transform("text", lambda x: F.exp(x))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    # pages without text know nothing and do not vote
    share = F.when(F.col("n_text") > 0, F.transform(weights, lambda x: x / total)).otherwise(F.array_repeat(F.lit(0.0), len(names)))
    rows = materialize(rows.withColumn("share", share), "page-evidence")

    everything = [x or 0.0 for x in rows.agg(*(F.sum(F.get("share", F.lit(i))) for i in range(len(names)))).first()]
    overall = [(x + SMOOTH) / (sum(everything) + SMOOTH * len(names)) for x in everything]
    base = F.array(*map(F.lit, overall))
    size = F.array(*(F.lit(x) for x in everything))

    # markup and path code have at most languages + 2 values: one small row each
    logs = [F.col("text")]
    for column in ("markup", "code"):
        sums = {r[0]: r[1] for r in _sum_by(rows, column, names, "sums").collect()}
        every = [*names, "other", "none"]
        table = [(v, [float(np.log(((sums.get(v) or [0.0] * len(names))[i] + SMOOTH / len(every)) / (everything[i] + SMOOTH))) for i in range(len(names))]) for v in every]
        table = rows.sparkSession.createDataFrame(table, f"{column} string, {column}_log array<double>")
        rows = rows.join(F.broadcast(table), column, "left")
        logs.append(F.col(f"{column}_log"))
    hosts, domains, suffixes = (_sum_by(rows, c, names, f"{c}_sums") for c in ("host", "domain", "suffix"))
    rows = rows.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    nothing = F.array_repeat(F.lit(0.0), len(names))
    without = lambda sums: F.zip_with(F.coalesce(sums, nothing), F.when(sums.isNotNull(), F.col("share")).otherwise(nothing), lambda a, b: F.greatest(a - b, F.lit(0.0)))
    smooth = lambda sums, prior: F.zip_with(sums, prior, lambda s, p: (s + SMOOTH * p) / (F.aggregate(sums, F.lit(0.0), lambda a, x: a + x) + SMOOTH))
    by_domain = smooth(without(F.col("domain_sums")), base)
    prior = smooth(without(F.col("host_sums")), by_domain)
    logs.append(F.transform(prior, lambda p: F.log(p)))
    suffix = F.zip_with(without(F.col("suffix_sums")), size, lambda s, n: F.log((s + SMOOTH / 8) / (n + SMOOTH)))
    logs.append(F.when(F.col("suffix_sums").isNotNull(), suffix).otherwise(nothing))

    best_of = lambda values: F.get(known, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
    rows = rows.withColumn("log", reduce(_plus, logs))
    top = F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("log")))
    return rows.select("page_id", best_of(F.col("log")).alias("lang"), F.round(1 / top, 6).alias("posterior"), F.when(F.col("n_text") > 0, best_of(F.col("text"))).alias("text_lang"), "declared", "host")
