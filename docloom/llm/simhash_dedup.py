"""SimHash near-duplicates: bit planes, carry-save counters, and components of all links within a Hamming radius."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from . import similar
from .bit_slices import linked_roots, sliced_links, votes
from .common import fresh, lookup, small, text_key, without, written
from .components import components

RADIUS, SHINGLE = 3, 3
#: A bucket with more fingerprints is split by further bits before it is compared.
BUCKET_ROWS, LEVELS = 20_000, 8


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a text; see `fingerprints`."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n]
    stops = ends[min(shingle, len(words)) - 1 :][:n]
    parts = map(joined.__getitem__, map(slice, starts.tolist(), stops.tolist()))
    hashes = np.frombuffer(b"".join(map(xxh64_digest, parts, repeat(42))), np.uint8)
    return int.from_bytes(np.packbits(votes(hashes, n) * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, out: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the text's key t, and the fingerprint as a long.

    A-Z is lower-cased, words are runs of anything but ASCII white space, shingles three words (all words, if fewer) and
    each shingle as often as it occurs; a bit is set if over half of the shingles' XXH64 hashes (seed 42) have it.  Null,
    empty and blank texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "t", out])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key().alias("t"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, t bigint, {out} bigint")


def _bucket_stars(bucket: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For fingerprints sorted by bucket, edges from each linked one to the root of its component within the bucket."""
    first, last = (np.searchsorted(bucket, bucket, side=x) for x in ("left", "right"))
    parent = linked_roots(len(fps), sliced_links(fps, first, last, radius))
    linked = np.flatnonzero(parent != np.arange(len(fps)))
    return fps[linked], fps[parent[linked]]


def _divisions(radius: int) -> list[list[int]]:
    """Ways to divide the 64 bits into radius + 1 parts, as masks: first by neighbouring bits, then by fixed shuffles."""
    out = []
    for level in range(LEVELS):
        bits = list(range(64))
        if level:
            np.random.default_rng(level).shuffle(bits)
        edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
        masks = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:])]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Edges (a, b) that join all fingerprints (column fp, distinct) within radius, directly or through others.

    Two that differ in at most r bits agree on one of r + 1 parts of the bits, however these are divided; so each part's
    value names a bucket.  A bucket over bucket_rows is divided again by another division, which by the same argument
    loses nothing; after LEVELS divisions hardly a bit is left in which the distinct fingerprints of one bucket differ.
    Should two keys share a hash, their buckets merge, which loses nothing either.  Within a bucket each fingerprint gives
    at most one edge, to the root of its component there.
    """
    ready, level = [], fps.select("fp", F.lit(0).cast("long").alias("bucket"))
    for n, masks in enumerate(_divisions(radius)):
        keys = [F.xxhash64("bucket", F.lit(n), F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks)]
        split = level.select("fp", F.explode(F.array(*keys)).alias("bucket"))
        big = written(split.groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket"), "big-buckets")
        n_big = big.count()
        if not n_big or n == LEVELS - 1:
            ready.append(split)
            break
        ready.append(split.join(small(big, n_big), "bucket", "left_anti").select("fp", "bucket"))
        level = written(split.join(small(big, n_big), "bucket", "left_semi").select("fp", "bucket"), "big-bucket-rows")
    edges = ready[0]
    for x in ready[1:]:
        edges = edges.unionByName(x)

    def stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            whole = pd.concat(held, ignore_index=True)
            # rows come sorted by bucket: all but the last bucket is complete
            cut = int(np.searchsorted(whole["bucket"].to_numpy(), whole["bucket"].iloc[-1])) if len(whole) else 0
            if cut:
                yield edges_of(whole.iloc[:cut])
            held = [whole.iloc[cut:]]
        if held and len(held[0]):
            yield edges_of(held[0])

    def edges_of(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = _bucket_stars(pdf["bucket"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return edges.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(stars, "a bigint, b bigint")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, t (its text's key), fp, component_id, the smallest doc_id reachable over links within radius.

    Equal fingerprints are one node, so a group of copies costs one row in the search.  Null ids are ignored when the
    smallest is taken; a component of null ids alone has a null id.  Repeated rows keep a row each.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprint-nodes")
    return _named(rows, nodes, links(nodes.select("fp"), radius))


def similar_groups(docs: DataFrame, shingle: int = similar.SHINGLE, similarity: float = similar.SIMILARITY) -> DataFrame:
    """As near_groups, but documents are linked if the Jaccard similarity of their sets of shingles is similarity or more.

    fp is a key of the set.  SimHashes are compared bit-sliced within a radius wide enough for the similarity, in buckets of
    shared shingles instead of Hamming blocks, which at such a radius would hold all pairs (see `similar`).
    """
    rows = written(similar.prefixes(docs, shingle, similarity), "shingle-prefixes")
    own = [F.min(_order()).alias("first"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("sim", "size", "least", "prefix")]]
    nodes = written(rows.groupBy("fp").agg(*own), "shingle-nodes")
    rows = rows.select("doc_id", "t", "fp")
    return _named(rows, nodes.select("fp", "first", "n"), similar.links(docs, rows, nodes, shingle, similarity))


def _order():
    """What the smallest document of a group is the smallest by: null ids last, then doc_id and the text's key."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("t").alias("t"))


def _named(rows: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows (doc_id, t, fp) with the component_id and component_t of their node (fp, first, n) by the edges (a, b) of nodes."""
    roots = components(edges).withColumnRenamed("node", "fp")
    joined = nodes.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    tops = joined.groupBy("root").agg(F.min("first").alias("top"), F.count(F.lit(1)).alias("m")).filter(F.col("m") > 1).select("root", "top")
    top = F.coalesce("top", "first")
    named = written(joined.join(tops, "root", "left").select("fp", "n", top["doc_id"].alias("component_id"), top["t"].alias("component_t")), "fingerprint-components")
    return lookup(rows, named, "fp", "n", rows.count()).drop("n")


def near_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; a row per document."""
    found = near_groups(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame) -> DataFrame:
    """docs less all but one document of each group of near copies; the one with the smallest doc_id stays.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more, directly or through others; op3's own rule
    (near_groups) binds its query alone.  Texts without a word (null, empty, blank) are near copies of each other.  Of
    documents that share the smallest id the one with the smallest text key stays, of rows that repeat both any one; a null
    id goes unless its whole group has none.
    """
    groups = written(similar_groups(docs), "near-groups")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("t") == F.col("component_t"))
    kept = without(docs, groups.filter(~stays).select(F.col("doc_id").alias("id"), "t"))
    repeated = written(groups.filter(stays).groupBy("doc_id", "t").count().filter("count > 1").select(F.col("doc_id").alias("id"), "t"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    k = fresh(docs.columns, "text_key")
    again = kept.withColumn(k, text_key()).alias("d").join(repeated.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.id")) & (F.col(f"d.{k}") == F.col("r.t")), "left_semi")
    return without(kept, repeated).unionByName(again.dropDuplicates(["doc_id", k]).drop(k))
