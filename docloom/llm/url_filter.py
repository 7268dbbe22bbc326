"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join; host rules come first."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A block is WORDS words of 64 bits; a key sets one bit in each.  BITS_PER_KEY bits a key give about 1 % false hits.
WORDS, BITS_PER_KEY = 8, 12
#: The filter is broadcast up to this size, else joined by block.
BROADCAST_BYTES = 32 << 20
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Urls with a ref parameter (affiliate links) make the query's list.
AFFILIATE = r"^[^?#]*\?([^#]*&)?ref="


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host without a leading www. or m., path without .html and closing slashes; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct (rule, verdict), null if none fits.  Compiled to one CASE, longest first."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _masks(key: Column) -> list[Column]:
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """block, w0 .. w7: a row for each block that isn't empty, built by bitwise OR with partial aggregation."""
    parts = keys.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col(key)))])
    return parts.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def listed_among(urls: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    """The distinct values of urls[key] that are listed, exactly, and n, how many rows of urls have each.

    listed may repeat and hold nulls; both are ignored.  The Bloom filter passes every listed value and few others, and
    only those that pass enter the exact join.  Equal urls are merged before the shuffle, so a hot url costs one row.
    """
    keys = written(listed.select(F.col(listed_key).alias("k")).filter(F.col("k").isNotNull()).distinct(), "listed-urls")
    n_blocks = max(1, math.ceil(keys.count() * BITS_PER_KEY / (64 * WORDS)))
    table = bloom(keys, "k", n_blocks)
    if n_blocks * (WORDS + 1) * 8 <= BROADCAST_BYTES:
        table = F.broadcast(table)
    probes = urls.select(F.col(key).alias("k")).filter(F.col("k").isNotNull()).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    probes = probes.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(n_blocks))).join(table, "block")
    for i, m in enumerate(_masks(F.col("k"))):
        probes = probes.filter(F.col(f"w{i}").bitwiseAND(m) != 0)
    return probes.select("k", "n").join(keys.hint("shuffle_hash"), "k", "left_semi").select(F.col("k").alias(key), "n")


def judge(pages: DataFrame, listed: DataFrame, listed_key: str, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A rule decides where one fits; elsewhere a page is blocked if its canonical URL is listed, else allowed.  Null and
    odd urls have an empty host and path, canonical form '', which is never taken as listed.  A url that many pages share is
    looked up in a bounded broadcast table, so its rows stay where they are.
    """
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rows = rows.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"), canonical(F.col("host"), F.col("path")).alias("canon"))
    open_rows = rows.filter(F.col("r").isNull() & (F.col("host") != ""))
    hits = written(listed_among(open_rows, "canon", listed.filter(F.col(listed_key) != ""), listed_key).withColumn("hit", F.lit(True)), "listed-hits")
    found = lookup(open_rows, hits, "canon", "n", pages.count()).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    ruled = rows.filter(F.col("r").isNotNull() | (F.col("host") == "")).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.lit("allow")).alias("verdict"))
    return ruled.unionByName(found)


def affiliate_list(pages: DataFrame) -> DataFrame:
    """canon: canonical URLs that some page was fetched under with a ref parameter; other pages of theirs may have none."""
    url = F.col("url").cast("string")
    return pages.filter(url.rlike("(?s)" + AFFILIATE)).select(canonical(host_of(url), path_of(url)).alias("canon"))


SQL = r"""
WITH parts AS (
  SELECT page_id, url,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), forms AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html)?/*$', '') AS canon FROM parts
), listed AS (
  SELECT DISTINCT canon FROM forms WHERE regexp_matches(url, '^[^?#]*\?([^#]*&)?ref=', 's')
), ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM forms
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host <> '' AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""


def judge_pages(pages: DataFrame) -> DataFrame:
    return judge(pages, affiliate_list(pages), "canon")
