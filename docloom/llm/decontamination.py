"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, text_key, text_or_empty, without, written

SHINGLE, SIMILARITY = 5, 0.8
#: Windows and items within RADIUS bits are compared exactly.  At similarity 0.8 the expected distance is about 10 of 64
#: bits with a standard deviation of 3, so 24 lies over four deviations out.
RADIUS = 24
#: Items are searched in parts of about so many shingles, whose hashes every task holds (some 6 MB); documents are read once a part.
PART_SHINGLES = 250_000
WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def _bound(df: DataFrame, keep: list[str], **exprs: Column) -> DataFrame:
    """df[keep] and the expressions, each evaluated once a row: no rule of the optimizer moves them through a generator."""
    for name, e in exprs.items():
        df = df.select(*keep, F.explode_outer(F.array(e)).alias(name))
        keep = [*keep, name]
    return df


def _hashed(k: int) -> Column:
    parts = ", ".join(f"words[i + {j}]" for j in range(k))
    return F.expr(f"CASE WHEN size(words) >= {k} THEN transform(sequence(0, size(words) - {k}), i -> xxhash64({parts})) ELSE CAST(array() AS array<bigint>) END")


def _needed(m: Column | str) -> str:
    """How many of m shingles a window of m must share for the similarity s: shared / (2 m - shared) >= s."""
    return f"CAST(ceil({2 * SIMILARITY / (1 + SIMILARITY)!r} * {m} - 1e-9) AS int)"


def _items(benchmark: DataFrame, k_of: int) -> DataFrame:
    """item_id, ik (a key of id and text, never null), item (its shingles' hashes, repeats included), m.

    Items of SHINGLE words or more, or of exactly k_of if fewer.
    """
    ik = F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("\x00null")), F.col("text"))
    b = benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("ik", ik).dropDuplicates(["ik"])
    b = _bound(b, ["item_id", "ik"], words=words(F.col("text")))
    b = b.filter(F.size("words") >= SHINGLE if k_of == SHINGLE else F.size("words") == k_of)
    return b.select("item_id", "ik", _hashed(k_of).alias("item")).withColumn("m", F.size("item"))


def _fingerprints(windows: DataFrame, by: list[str], hashes: str, longest: int) -> DataFrame:
    """by and fp: a bit is set if over half of the hashes have it.

    The votes of four bits (two, where a window may have over 32767 hashes) are counted in the lanes of one long; adding
    what lacks from a majority to half a lane's range leaves the majority in each lane's top bit.
    """
    width = 16 if longest < 1 << 15 else 32
    ones = sum(1 << i for i in range(0, 64, width))
    bits = windows.select(*by, F.explode(hashes).alias("h"))
    lanes = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(ones))).alias(f"lane{i}") for i in range(width)]
    votes = bits.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *lanes)
    lacks = (F.lit((1 << (width - 1)) - 1) - F.floor(F.col("n") / 2)) * F.lit(ones)
    votes = votes.select(*by, lacks.alias("lacks"), *[f"lane{i}" for i in range(width)])
    parts = []
    for i in range(width):  # no lane overflows, but the topmost may reach the sign: wrap without the ANSI check
        majority = F.shiftrightunsigned(_wrapping_sum(F.col(f"lane{i}"), F.col("lacks")), width - 1).bitwiseAND(F.lit(ones))
        parts.append(F.shiftleft(majority, i))
    while len(parts) > 1:
        parts = [parts[i].bitwiseOR(parts[i + 1]) for i in range(0, len(parts), 2)]
    return _bound(votes, by, fp=parts[0])


def _wrapping_sum(a: Column, b: Column) -> Column:
    """a + b of two non-negative longs modulo 2^64: the low 32 bits, then the high ones with the carry."""
    low = a.bitwiseAND(F.lit(0xFFFFFFFF)) + b.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF)))


def _blocks(fp: str, radius: int) -> Column:
    """The values of radius + 1 parts of the bits; two fingerprints within radius agree on one of them."""
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(F.col(fp), a).bitwiseAND(F.lit((1 << (b - a)) - 1)).cast("int") for a, b in zip(edges, edges[1:])])


@contextmanager
def _set_of(index: DataFrame, n: int) -> Iterator[Callable[[str], str]]:
    """What tells in SQL whether a hash is one of index's hashes h; n bounds these, so it's some 24 n bytes a task.

    A session variable holds them in an array of arrays by the lowest bits; a look takes one step to an array and a
    comparison or two.
    """
    spark, name = index.sparkSession, "docloom_shingles_" + uuid.uuid4().hex
    size = 1 << max(4, (n // 2).bit_length())
    found = index.select("h").distinct().groupBy(F.col("h").bitwiseAND(F.lit(size - 1)).cast("int").alias("slot")).agg(F.collect_list("h").alias("own"))
    every = spark.range(size).select(F.col("id").cast("int").alias("slot")).join(found, "slot", "left")
    own = F.coalesce("own", F.array().cast("array<bigint>")).alias("own")
    one = every.agg(F.sort_array(F.collect_list(F.struct("slot", own))).alias("x")).select(F.expr("transform(x, y -> y.own)").alias("slots"))
    written(one, "benchmark-hashes").createOrReplaceTempView(name)
    spark.sql(f"DECLARE OR REPLACE VARIABLE {name} ARRAY<ARRAY<BIGINT>>")
    spark.sql(f"SET VARIABLE {name} = (SELECT slots FROM {name})")
    try:
        yield lambda h: f"array_contains({name}[CAST({h} & {size - 1} AS int)], {h})"
    finally:
        spark.sql(f"DROP TEMPORARY VARIABLE {name}")
        spark.catalog.dropTempView(name)


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", radius: int = RADIUS, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """A row for each document and benchmark item that it holds: key, t (its text's key), item_id, start (in words), similarity.

    Words are lower-case runs of letters and digits, shingles five words (an item of fewer is one shingle).  A document
    holds an item if a window of the item's size has a weighted Jaccard similarity of shingles, each weighted by how often
    it occurs, of 0.8 or more.  similarity is that of the best window; start is the first of the best windows that begin
    with a shared shingle or end with the document.

    1. Documents are cut into shingle hashes, and the positions of hashes that the benchmark has are kept.  A document
       whose windows all hold too few of them for any item's size is left out there; nothing is shuffled for it.
    2. Shifting a window to its next shared shingle, or to the document's end, loses no shared shingle; so windows start
       at positions shared with an item of their size, or end with the document, and need enough positions shared with it.
    3. A window's SimHash meets those of the items it shares these with through radius + 1 Hamming blocks, in an index by
       item, block and value, so that all within the radius are found and no others are compared.
    4. The shingles of window and item are compared exactly.

    A benchmark of more than part_shingles shingles is searched part by part, by the same plan.  Null, empty and short texts
    hold nothing; items without a word are left out; a benchmark without rows gives no rows.  Repeated rows and ids give one
    row an item.  Null keys are kept as a key of their own.
    """
    spark = docs.sparkSession
    lengths = [r[0] for r in benchmark.select(F.least(F.size(words(F.col("text").cast("string"))), F.lit(SHINGLE)).alias("k")).filter("k > 0").distinct().collect()]
    out = None
    for k in sorted(lengths):
        items = written(_items(benchmark, k), "benchmark-items")
        parts = max(1, math.ceil(items.agg(F.sum(F.size(F.array_distinct("item")))).first()[0] / part_shingles))
        for part in range(parts):
            found = _leaks(docs, items.filter(F.pmod(F.xxhash64("ik"), F.lit(parts)) == part), key, k, radius)
            if found is not None:
                out = found if out is None else out.unionByName(found)
    if out is None:
        kinds = f"{key} {docs.schema[key].dataType.simpleString()}, t bigint, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start int, similarity double"
        return spark.createDataFrame([], kinds)
    return out


def _leaks(docs: DataFrame, items: DataFrame, key: str, k: int, radius: int) -> DataFrame | None:
    checked, _ = _candidates(docs, items, key, k, radius)
    if checked is None:
        return None
    both = F.expr("aggregate(array_distinct(item), 0, (n, x) -> n + least(size(filter(item, y -> y = x)), size(filter(own, y -> y = x))))")
    checked = checked.select(key, "t", "item_id", "start", F.size("item").alias("a"), F.size("own").alias("b"), both.alias("both"))
    checked = checked.withColumn("similarity", F.col("both") / (F.col("a") + F.col("b") - F.col("both"))).filter(F.col("similarity") >= SIMILARITY - 1e-12)
    best = checked.groupBy(key, "t", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("x"))
    return best.select(key, "t", "item_id", (-F.col("x.s")).alias("start"), F.col("x.similarity").alias("similarity"))


def _candidates(docs: DataFrame, items: DataFrame, key: str, k: int, radius: int) -> tuple[DataFrame | None, DataFrame | None]:
    """key, t, start, own, item_id, item of the windows and items to be compared exactly; and the windows."""
    index = written(items.select("ik", "m", F.explode(F.array_distinct("item")).alias("h")), "benchmark-shingles")
    n_index, sizes = index.count(), sorted(r[0] for r in items.select("m").distinct().collect())
    if not n_index:
        return None, None
    rows = docs.select(F.col(key).alias("k"), text_or_empty().alias("text")).select("k", "text", text_key().alias("t"))
    rows = _bound(_bound(rows, ["k", "t"], words=words(F.col("text"))), ["k", "t"], h=_hashed(k))
    ms, longest = ", ".join(map(str, sizes)), max(sizes, default=1)
    need = f"least({_needed('m')}, {_short('m')})"
    dense = F.expr(f"exists(array({ms}), m -> size(p) >= {need} AND exists(sequence(0, size(p) - 1), i -> get(p, i + {need} - 1) < p[i] + m))")
    with _set_of(index, n_index) as inside:
        rows = _bound(rows, ["k", "t", "h"], p=F.expr(f"filter(sequence(0, size(h) - 1), i -> size(h) > 0 AND {inside('h[i]')})"))
        dense_rows = written(rows.filter(F.size("p") > 0).filter(dense).dropDuplicates(["k", "t"]), "dense-documents")

    shared = dense_rows.select("k", "t", F.size("h").alias("d"), F.explode("p").alias("pos"), "h").select("k", "t", "d", "pos", F.expr("h[pos]").alias("h"))
    shared = shared.join(small(index, n_index), "h").groupBy("k", "t", "d", "ik", "m").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    starts = F.expr(
        f"concat(filter(p, (x, i) -> x <= d - m AND get(p, i + {need} - 1) < x + m), "
        f"CASE WHEN get(p, size(p) - {need}) >= greatest(0, d - m) THEN array(greatest(0, d - m)) ELSE CAST(array() AS array<int>) END)"
    )
    windows = shared.filter(f"size(p) >= {need}").select("k", "t", "m", "ik", F.explode(starts).alias("start"))
    windows = windows.groupBy("k", "t", "m", "start").agg(F.collect_set("ik").alias("iks"))
    slices = windows.join(dense_rows.select("k", "t", "h"), windows["k"].eqNullSafe(dense_rows["k"]) & (windows["t"] == dense_rows["t"]))
    slices = written(slices.select(windows["k"], windows["t"], "m", "start", "iks", F.expr("slice(h, start + 1, least(m, size(h)))").alias("own")), "windows")

    by, n_items = ["k", "t", "m", "start"], items.count()
    prints = _fingerprints(slices.select(*by, "own"), by, "own", longest)
    marked = slices.join(prints.select(*[F.col(c).alias(f"{c}_") for c in by], "fp"), F.col("k").eqNullSafe(F.col("k_")) & (F.col("t") == F.col("t_")) & (F.col("m") == F.col("m_")) & (F.col("start") == F.col("start_")))
    marked = marked.select("k", "t", "start", "own", "fp", _blocks("fp", radius).alias("b"), F.explode("iks").alias("ik"))
    marked = written(marked, "window-fingerprints")
    probes = marked.select("k", "t", "start", "ik", "fp", "b", F.posexplode("b").alias("block", "value"))
    of_items = _bound(_fingerprints(items, ["ik", "m"], "item", longest), ["ik", "fp"], b=_blocks("fp", radius))
    of_items = of_items.select("ik", F.col("fp").alias("fp_"), F.col("b").alias("b_"), F.posexplode("b").alias("block", "value"))
    met = probes.join(small(of_items, n_items * (radius + 1)), ["ik", "block", "value"])
    # A pair that meets in several blocks counts in the first of them only.
    first = F.expr("NOT exists(sequence(0, size(b) - 1), i -> i < block AND b[i] = b_[i])")
    pairs = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_"))) <= radius).filter(first).select(*[F.col(c).alias(f"{c}_") for c in ("k", "t", "start", "ik")])
    same = F.col("k").eqNullSafe(F.col("k_")) & (F.col("t") == F.col("t_")) & (F.col("start") == F.col("start_")) & (F.col("ik") == F.col("ik_"))
    checked = marked.join(pairs, same, "left_semi").join(small(items.select("ik", "item_id", "item"), n_items), "ik")
    return checked.select(F.col("k").alias(key), "t", "start", "own", "item_id", "item"), slices


def _short(m: str) -> str:
    """What a document shorter than its window must share: shared / (m + d - shared) >= s with d >= shared gives s * m."""
    return f"CAST(ceil({SIMILARITY!r} * {m} - 1e-9) AS int)"


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs less the documents that hold an item of the benchmark, with all their columns; a null id is an id like others."""
    found = leaks(docs, benchmark).select("doc_id", "t").withColumnRenamed("doc_id", "id")
    return without(docs, found)
