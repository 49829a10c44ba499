import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "https://a.example.com/en/1", "https://www.example.com/en/1", "http://x.www.EXAMPLE.com/en/", "http://notexample.com/en/1", "http://example.com", "http://net/es/1", "http://a.net/es/", "http://a.net/esx/",
    "http://a.org/x?b=2&a=1#top", "https://A.org:443/x/?a=1&utm_source=f&b=2", "http://a.org:80/x?a=1&b=2", "http://a.org/y", "http://a.org/x?b=2", "foo?u=http://b.org/q", "http://c.org/a\n/b?x#y?z", "http://d.org?x://y/z", "http://" + "p" * 200000 + ".org/",
    "ftp://a.org:443/x?a=1&b=2", "http://a.org/x?ref=r&refx=1", "http://é.org/Ü",
]
LISTED = ["http://a.org/x?a=1&b=2", "http://a.org/x?a=1&b=2#again", None, "nothing", "https://c.org/a\n/b?x", "http://a.net/es/"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    own = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in own), re.split(r"[?#]", rest[len(own) :])[0]


def canonical(url):
    if url is None or "://" not in url:
        return None
    own, way = parts(url)
    port = {"http": ":80", "https": ":443"}.get(url.split("://")[0].lower())
    own = own.removesuffix(port) if port else own
    query = url.split("#")[0].split("://", 1)[1].partition("?")[2]
    kept = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[a-z]+|ref|fbclid|gclid)(=|$)", p))
    return own + way.rstrip("/") + ("?" + "&".join(kept) if kept else "")


def expected(url, listed):
    own, way = parts(url)
    fit = [(len(rule), rule, says) for says, rule in url_filter.RULES for h, p in [rule.split("/", 1)] if (own == h or own.endswith("." + h)) and way.startswith("/" + p)]
    if fit:
        return own, way, max(fit)[1], max(fit)[2], None
    hit = canonical(url) in {canonical(x) for x in listed} - {None}
    return own, way, None, "block" if hit else "allow", hit


@pytest.mark.parametrize("most_bytes", [1 << 20, 1])
def test_verdicts_equal_a_plain_version(spark, most_bytes):
    urls = spark.createDataFrame([(i % 20, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    urls = urls.withColumns({c: F.lit("clash") for c in ("rule", "host", "hash", "block", "may", "b0", "w0")})
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    got = url_filter.judge(urls, listed, most_bytes=most_bytes).collect()
    assert len(got) == len(URLS) * 2 and got[0]["w0"] == "clash"
    wanted = [(i % 20, u, *expected(u, LISTED)) for i, u in enumerate(URLS * 2)]
    assert sorted(map(repr, [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict, r.listed) for r in got])) == sorted(map(repr, wanted))


def test_empty_list_and_table(spark):
    urls = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [r.verdict for r in url_filter.judge(urls, urls.select("url").limit(0)).collect()] == ["allow"]
    assert url_filter.judge(urls.limit(0), urls.select("url")).collect() == []
    assert url_filter.verdicts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_filter_holds_all_it_was_given_and_few_others(spark):
    hashes = spark.range(20000).select(F.xxhash64("id").alias("hash"))
    bloom = url_filter.BlockedBloom.of(hashes, 20000)
    assert bloom.may_hold(np.array([r.hash for r in hashes.collect()], np.int64)).all()
    others = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 50000)
    assert bloom.may_hold(others).mean() < 0.005
    assert len(bloom.words) * 256 >= 16 * 20000
    small = url_filter.BlockedBloom.of(hashes, 20000, most_bytes=1024)
    assert small.words.nbytes <= 1024 and small.may_hold(np.array([r.hash for r in hashes.collect()], np.int64)).all()


def test_same_rows_for_any_order_of_rules(spark):
    urls = spark.createDataFrame([(u,) for u in URLS], "url string")
    rule = lambda rules: [tuple(r) for r in urls.select(*url_filter.fitting_rule(url_filter.host(F.col("url")), url_filter.path(F.col("url")), rules)).collect()]
    assert rule(url_filter.RULES) == rule(url_filter.RULES[::-1])
