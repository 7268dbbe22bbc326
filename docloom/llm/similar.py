"""Documents whose shingles have a Jaccard similarity or more: SimHash compared in buckets of shared shingles, then exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest, xxh64_intdigest

from .bit_slices import linked_roots, sliced_links, votes
from .common import discard, lean, small, text_key, written
from .components import components

SHINGLE, SIMILARITY = 5, 0.8
#: A set of shingles is sketched by the SKETCH smallest hashes.  How many of these two similar sets share at least is
#: certain for sets up to SKETCH, for larger ones it holds but for a CHANCE (18 at similarity 0.8).
SKETCH, CHANCE = 48, 1e-9
#: SimHashes of similar sets: at similarity 0.8 the expected distance is 9.7 of 64 bits with a deviation of 2.9.
RADIUS = 24
#: Shingles in COMMON_FROM or more of about SAMPLE documents are common, MOST_COMMON of them at most; they go last in the
#: order of shingles.  Any order gives the same pairs; this one keeps the buckets small.
SAMPLE, COMMON_FROM, MOST_COMMON = 20_000, 3, 200_000
#: A bucket with more rows is compared in parts, each pair of parts in a task of its own.
BUCKET_ROWS = 20_000
#: Sets that are compared exactly in one place are some BLOCK on either side.
BLOCK = 64


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64 hashes (seed 42), ascending; words as in `simhash_dedup.fingerprints`.

    A text of fewer words is one shingle, so that texts without a word have the empty one.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends + 1][:n]
    stops = ends[shingle - 1 :] if len(words) >= shingle else np.array([len(joined)])
    parts = map(joined.__getitem__, map(slice, starts.tolist(), stops.tolist()))
    return np.unique(np.frombuffer(b"".join(map(xxh64_digest, parts, repeat(42))), ">u8").astype(np.uint64))


def least(n: int | np.ndarray, share: float) -> np.ndarray:
    """The smallest whole number that is share of n or more."""
    return np.ceil(share * np.asarray(n) - 1e-9).astype(np.int64)


def surely_shared(n: int, similarity: float = SIMILARITY) -> int:
    """How many hashes the sketches of a set of n shingles and of any set similar to it share.

    Sets of a and b hold least(a + b, s / (1 + s)) in common.  A sketch lacks what its set has beyond SKETCH, so up to that
    size the count is certain.  Where both are larger, the SKETCH smallest hashes of both together are draws each of which
    is shared with probability s or more: the count that they miss by at most CHANCE.
    """
    if n <= SKETCH:
        most = int(n / similarity + 1e-9)
        small_ones = int(least(n, similarity))
        return max(1, min(small_ones, *(int(least(n + b, similarity / (1 + similarity))) - max(0, b - SKETCH) for b in (n, most))))
    below = 0.0
    for k in range(SKETCH):
        below += math.comb(SKETCH, k) * similarity**k * (1 - similarity) ** (SKETCH - k)
        if below > CHANCE:
            break
    return max(1, k)


def _common(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles, ascending, and in how many sampled documents each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), shingle).view(np.int64))], names=["h"])

    bound = math.ceil(min(1.0, SAMPLE / max(1, docs.count())) * (1 << 30))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", text_key()), F.lit(1 << 30)) < bound).select(F.col("text").cast("string").alias("text"))
    counts = sample.mapInArrow(lean(run), "h bigint").groupBy("h").count().filter(F.col("count") >= COMMON_FROM)
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).toPandas()
    at = np.argsort(top["h"].to_numpy(np.int64).view(np.uint64))
    return top["h"].to_numpy(np.int64).view(np.uint64)[at], top["count"].to_numpy(np.int64)[at]


def prefixes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, t (its text's key), fp (a key of its set of shingles), sim (its SimHash), size of the set, least, prefix.

    prefix is the first of the sketch's hashes in the order of all shingles, so many that one of them must be among those
    that surely are shared (least).  A row has at most SKETCH of them, whatever the text's length.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_common(docs, shingle))

    def prefix(own: np.ndarray, need: int) -> np.ndarray:
        common, count = shared.value
        weight = np.zeros(len(own), np.int64)
        if len(common):
            at = np.minimum(np.searchsorted(common, own), len(common) - 1)
            weight = np.where(common[at] == own, count[at], 0)
        return own[np.lexsort((own, weight))][: len(own) - need + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sims, sizes, needs, lists = [], [], [], [], []
            for t in b.column(2):
                own = shingles(t.as_py(), shingle)
                fps.append(xxh64_intdigest(own.tobytes()))
                sims.append(int.from_bytes(np.packbits(votes(own.astype(">u8").view(np.uint8), len(own)) * 2 > len(own)).tobytes(), "big"))
                sizes.append(len(own))
                needs.append(surely_shared(len(own), similarity))
                lists.append(prefix(own[:SKETCH], needs[-1]).view(np.int64))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, sims)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *longs, pa.array(sizes, pa.int32()), pa.array(needs, pa.int32()), pa.array(lists, pa.list_(pa.int64()))],
                names=["doc_id", "t", "fp", "sim", "size", "least", "prefix"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("t"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, t bigint, fp bigint, sim bigint, size int, least int, prefix array<bigint>")


def by_bucket(of):
    """A function for mapInPandas that gives `of` whole buckets of rows that come sorted by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            whole = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(whole):
                continue
            cut = int(np.searchsorted(whole["bucket"].to_numpy(), whole["bucket"].iloc[-1]))  # all but the last is complete
            if cut:
                yield from of(whole.iloc[:cut])
            held = whole.iloc[cut:]
        if held is not None and len(held):
            yield from of(held)

    return lean(run)


def close_pairs(pdf: pd.DataFrame, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows, sorted by (bucket, size), that may be similar: near sizes, room for what is shared, near SimHashes.

    A pair is compared where its first shared hash puts it, and behind that both sketches have room for the others.
    """
    bucket, size, at = pdf["bucket"].to_numpy(), pdf["size"].to_numpy(np.int64), pdf["at"].to_numpy(np.int64)
    need, part, other = pdf["least"].to_numpy(np.int64), pdf["part"].to_numpy(), pdf["other"].to_numpy()
    n = len(pdf)
    nth = np.cumsum(np.r_[0, bucket[1:] != bucket[:-1]])
    base = int(size.max()) + 2
    reach = np.minimum(np.floor(size / similarity + 1e-9).astype(np.int64), base - 1)
    last = np.searchsorted(nth * base + size, nth * base + reach, side="right")
    room = np.minimum(size, SKETCH) - at
    for i, j in sliced_links(pdf["sim"].to_numpy().view(np.uint64), np.arange(n), last, RADIUS):
        ok = (np.minimum(room[i], room[j]) >= np.minimum(need[i], need[j])) & ((part[i] != part[j]) | (part[i] == other[i]))
        yield i[ok], j[ok]


def centres(sims: np.ndarray, fps: np.ndarray, root: np.ndarray) -> np.ndarray:
    """For each row the place of its group's centre: the SimHash nearest to the majority of the group's bits, least fp first."""
    group = np.unique(root, return_inverse=True)[1]
    n = np.bincount(group)
    distance = np.zeros(len(sims), np.int64)
    for b in range(64):
        bit = (sims >> np.int64(b)) & 1
        distance += bit != (2 * np.bincount(group, bit) > n)[group]
    order = np.lexsort((fps, distance, group))
    first = order[np.r_[True, group[order][1:] != group[order][:-1]]]
    return first[group]


def buckets(nodes: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """bucket, fp, sim, size, least, at, part, other: a row for each node and hash of its prefix.

    A bucket over bucket_rows is cut into parts by the node's hash, and each two parts meet in a bucket of their own, in
    which only pairs over parts count; so no task holds more than two parts, and no pair is lost.
    """
    rows = nodes.select("fp", "sim", "size", "least", F.posexplode("prefix").alias("at", "bucket")).withColumn("part", F.lit(0)).withColumn("other", F.lit(0))
    crowded = written(rows.groupBy("bucket").count().filter(F.col("count") > bucket_rows), "crowded-shingles")
    n = crowded.count()
    if not n:
        return rows
    parts = F.ceil(F.col("count") / F.lit(bucket_rows)).cast("int")
    cut = rows.drop("part", "other").join(small(crowded, n), "bucket").withColumn("part", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.withColumn("bucket", F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))).drop("count")
    return rows.join(small(crowded, n), "bucket", "left_anti").unionByName(cut)


def links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) of similar nodes (fp, sim, size, least, prefix) that join all similar ones, directly or through others.

    First each close node is compared exactly with the centre of its close ones in a bucket only; then all close pairs that
    these edges leave in different components are.  So a group of n near copies of one text costs about n comparisons.
    """

    def stars(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values(["bucket", "size", "fp"], kind="stable")
        root = linked_roots(len(pdf), close_pairs(pdf, similarity))
        near = np.bincount(root, minlength=len(pdf))[root] > 1
        if near.any():
            pdf, root = pdf[near], root[near]
            fp = pdf["fp"].to_numpy()
            yield pdf.assign(root=fp[centres(pdf["sim"].to_numpy(), fp, root)])

    def apart(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values(["bucket", "size", "fp"], kind="stable")
        fp, root = pdf["fp"].to_numpy(), pdf["root"].to_numpy()
        for i, j in close_pairs(pdf, similarity):
            far = root[i] != root[j]
            i, j = i[far], j[far]
            if len(i):
                yield pd.DataFrame({"a": np.minimum(fp[i], fp[j]), "b": np.maximum(fp[i], fp[j])}).drop_duplicates()

    kinds = "fp bigint, sim bigint, size int, least int, at int, bucket bigint, part int, other int"
    cut = lambda df: df.repartition("bucket").sortWithinPartitions("bucket")
    spread = buckets(nodes, bucket_rows).select(*[k.split()[0] for k in kinds.split(", ")])
    close = written(cut(spread).mapInPandas(by_bucket(stars), kinds + ", root bigint"), "close-shingles")
    first = close.filter("fp <> root").select(F.least("fp", "root").alias("a"), F.greatest("fp", "root").alias("b")).distinct()
    edges = written(similar(docs, rows, written(first, "close-pairs"), shingle, similarity), "similar-pairs")
    own = components(edges).withColumnRenamed("node", "fp").withColumnRenamed("root", "top")
    joined = close.drop("root").join(own, "fp", "left").withColumn("root", F.coalesce("top", "fp")).drop("top")
    left = written(cut(joined.select(*close.columns)).mapInPandas(by_bucket(apart), "a bigint, b bigint").distinct(), "close-pairs")
    discard(close)
    return edges.unionByName(similar(docs, rows, left, shingle, similarity))


def similar(docs: DataFrame, rows: DataFrame, pairs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have the similarity or more; rows say which text (t) has which set (fp).

    Sets that pairs connect are cut into parts of about `block`, and the pairs between two parts are compared in one place,
    so that a set travels once for each part that it meets and not once for each pair.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t.as_py(), shingle).tobytes() for t in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), sets], names=["fp", "own"])

    def check(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        is_set = pdf["own"].notna().to_numpy()
        own = {k: np.frombuffer(x, np.uint64) for k, x in zip(pdf["a"][is_set].tolist(), pdf["own"][is_set])}
        found = []
        for a, b in zip(pdf["a"][~is_set].tolist(), pdf["b"][~is_set].tolist()):
            x, y = own[a], own[b]
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= (similarity - 1e-12) * (len(x) + len(y) - both):
                found.append((a, b))
        yield pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    family = written(components(pairs), "close-families")
    parts = family.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    placed = family.join(parts, "root").select(F.col("node").alias("fp"), "root", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    placed = written(placed, "close-parts")
    ends = [placed.select(F.col("fp").alias(x), F.col("root").alias(f"root_{x}"), F.col("part").alias(f"part_{x}")) for x in "ab"]
    at = F.xxhash64("root_a", F.least("part_a", "part_b"), F.greatest("part_a", "part_b"))
    met = written(pairs.join(ends[0], "a").join(ends[1], "b").select(at.alias("bucket"), "a", "b"), "close-blocks")

    wanted = written(rows.join(placed.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.min("t").alias("t")), "similar-texts")
    texts = docs.select(text_key().alias("t"), F.col("text").cast("string").alias("text")).join(small(wanted, wanted.count()), "t").select("fp", "text")
    sets = written(texts.mapInArrow(lean(cut), "fp bigint, own binary").groupBy("fp").agg(F.first("own").alias("own")), "similar-sets")
    members = met.select("bucket", F.col("a").alias("fp")).union(met.select("bucket", F.col("b").alias("fp"))).distinct().join(sets, "fp")
    every = met.select("bucket", "a", "b", F.lit(None).cast("binary").alias("own")).union(members.select("bucket", "fp", F.col("fp").alias("b"), "own"))
    return every.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(by_bucket(check), "a bigint, b bigint")
