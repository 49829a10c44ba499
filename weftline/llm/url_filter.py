"""Verdicts on URLs: short lists of host rules first, then a large list of canonical URLs behind a blocked Bloom filter.

Every listed URL sets eight bits within one block of 256 (two in each of four
64-bit words), so that a look-up touches one block. The blocks are made by a
grouping, OR-ed where the rows lie, and only the finished filter leaves the
cluster. Its size follows the list's up to ``most_bytes``; beyond that it passes
more and more URLs that are not listed, never fewer that are. What it passes goes
to an exact hash join with the list; what it does not is not shuffled at all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Shared, materialize

#: (verdict, host and path prefix): the longest that fits wins. Fixed values.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Query parameters that do not change what a URL shows.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"
DEFAULT_PORTS = {"http": "80", "https": "443"}
BITS_PER_URL = 16
MOST_BYTES = 16 << 20
#: List rows in one partition of a hash join at most; beyond, Spark sorts.
HASH_ROWS = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = 4
#: Odd multipliers, a pair for each word, of the 32-bit hash from which the bits follow.
_SALTS = [int(x) | 1 for x in np.random.default_rng(11).integers(1 << 20, 1 << 31, 2 * _WORDS)]


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The form in which URLs that show the same are equal; null for null and without ``://``.

    Scheme, fragment, default port, trailing slashes of the path and tracking
    parameters go; the other parameters are sorted.
    """
    scheme = F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    own = host(url)
    for name, port in DEFAULT_PORTS.items():
        own = F.when((scheme == name) & own.endswith(f":{port}"), F.regexp_replace(own, f":{port}$", "")).otherwise(own)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING))))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.contains(url, F.lit("://")), F.concat(own, F.regexp_replace(path(url), r"/+$", ""), query))


def fitting_rule(own_host: Column, own_path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), both null if no rule fits: its host is the URL's or a parent of it, and its path begins the URL's.

    Rules are a list of the caller's, tried one by one; of rules that fit the longest wins, of equally long ones the first.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, prefix = re.match(r"(?s)([^/]*)(.*)", text).groups()
        fits = ((own_host == name) | own_host.endswith("." + name)) & own_path.startswith(prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _hash(value: Column) -> Column:
    return F.xxhash64(value)


class BlockedBloom:
    """Blocks of four 64-bit words; a power of two of them."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    @staticmethod
    def blocks_for(urls: int, most_bytes: int = MOST_BYTES) -> int:
        """Least power of two of blocks with room for so many URLs, within ``most_bytes``."""
        need = max(1, urls * BITS_PER_URL // (64 * _WORDS))
        most = max(1, most_bytes // (8 * _WORDS))
        return 1 << min((need - 1).bit_length(), most.bit_length() - 1)

    @classmethod
    def of(cls, listed: DataFrame, urls: int, most_bytes: int = MOST_BYTES) -> BlockedBloom:
        """The filter of ``listed`` (hash long): rows of equal block are OR-ed by a grouping that combines before it shuffles."""
        blocks = cls.blocks_for(urls, most_bytes)
        low = F.col("hash").bitwiseAND(F.lit(0xFFFFFFFF))
        bit = lambda salt: F.shiftright((low * salt).bitwiseAND(F.lit(0xFFFFFFFF)), 27)
        one = F.lit(1).cast("long")
        # shiftleft takes its distance from a column only as an expression of SQL
        spread = listed.select(F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(blocks - 1)).alias("block"), *(bit(s).cast("int").alias(f"b{i}") for i, s in enumerate(_SALTS)))
        masks = [F.call_function("shiftleft", one, F.col(f"b{2 * w}")).bitwiseOR(F.call_function("shiftleft", one, F.col(f"b{2 * w + 1}") + 32)).alias(f"w{w}") for w in range(_WORDS)]
        made = spread.select("block", *masks).groupBy("block").agg(*(F.bit_or(f"w{w}").alias(f"w{w}") for w in range(_WORDS)))
        rows = made.toArrow()
        words = np.zeros((blocks, _WORDS), np.uint64)
        where = rows.column("block").to_numpy()
        for w in range(_WORDS):
            words[where, w] = rows.column(f"w{w}").to_numpy().view(np.uint64)
        return cls(words)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each 64-bit hash may be listed; never false for one that is."""
        h = hashes.view(np.uint64)
        own = self.words[(h >> np.uint64(32)) & np.uint64(len(self.words) - 1)]
        low = h & np.uint64(0xFFFFFFFF)
        passed = np.ones(len(h), bool)
        for i, salt in enumerate(_SALTS):
            bit = ((low * np.uint64(salt)) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
            passed &= (own[:, i // 2] >> (bit + np.uint64(32 * (i % 2)))) & np.uint64(1) > 0
        return passed


def judge(urls: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]] = RULES, most_bytes: int = MOST_BYTES) -> DataFrame:
    """All columns of ``urls`` (url, ...) with host, path, rule, verdict ("allow" or "block") and listed (of the canonical URL).

    The verdict is that of the longest rule that fits; where none does, URLs whose
    canonical form is in ``listed`` (url, in any form) are blocked. ``listed`` is
    null where a rule fits, as nothing is looked up. Null URLs and those without
    ``://`` have an empty host and path and are allowed. Rows are independent;
    columns of the five names are replaced. The list may be empty or repeat itself.
    """
    names = ["host", "path", "rule", "verdict", "listed"]
    urls = urls.drop(*names, "weftline_url", "weftline_hash")
    url = F.col("url").cast("string")
    known = listed.select(canonical(F.col("url").cast("string")).alias("weftline_url")).where("weftline_url is not null").distinct()
    known = materialize(known.withColumn("hash", _hash(F.col("weftline_url"))), "listed-urls")
    n = known.count()
    held = Shared(urls.sparkSession, BlockedBloom.of(known, n, most_bytes))

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(held.value.may_hold(hashes.to_numpy(np.int64)))

    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    told = urls.withColumns({"host": host(url), "path": path(url)}).withColumns({"rule": rule, "verdict": says})
    ruled = told.where("rule is not null").withColumn("listed", F.lit(None).cast("boolean"))
    open_ = told.where("rule is null").withColumn("weftline_url", canonical(url))
    nowhere = F.coalesce(_hash(F.col("weftline_url")), F.lit(0).cast("long"))
    probed = open_.withColumn("weftline_may", F.col("weftline_url").isNotNull() & may_hold(nowhere))
    clear = probed.where("not weftline_may").withColumn("listed", F.lit(False))
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    exact = known.select("weftline_url", F.lit(True).alias("listed"))
    exact = exact.hint("shuffle_hash") if n <= HASH_ROWS * parts else exact
    hits = probed.where("weftline_may").join(exact, "weftline_url", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = [*urls.columns, *names]
    method = F.when(F.col("listed"), "block").otherwise("allow")
    rest = clear.select(*urls.columns, *names).unionByName(hits.select(*out)).withColumn("verdict", method)
    return ruled.select(*out).unionByName(rest)


#: Marks in the names of hosts whose pages, and what those link to, a list of unwanted URLs is made of.
UNWANTED = r"(^|\.)(casino-win|cheap-pills|ads-track|spam-farm)\."


def listing(pages: DataFrame) -> DataFrame:
    """(url): of the pages (url, html) of unwanted hosts, and of what these link to on their own host."""
    own = pages.where(F.regexp_like(host(F.col("url").cast("string")), F.lit(UNWANTED)))
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'href="(/[^"]*)"'), 1)
    base = F.concat(F.lit("http://"), host(F.col("url")))
    return own.select(F.explode(F.concat(F.array("url"), F.transform(links, lambda u: F.concat(base, u)))).alias("url"))


def verdicts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) for each row of ``pages`` (page_id, url, html, ...)."""
    found = judge(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"), listing(pages))
    return found.select("page_id", "host", "path", "rule", "verdict", "listed")
