"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh

#: Slots are numbered within this many buckets of each shard, never in one task for a whole shard.
SLOT_BUCKETS = 1024


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the largest score -w / ln(u), where u in (0, 1) is a hash of key and shard number.

    Every shard's score depends on the key and that shard alone, so a new shard takes rows only into itself and a change
    of one weight moves rows only to or from that shard.  A shard of weight 0 gets nothing; ties go to the lower number.
    A null key hashes to a value of its own kind: all null keys share a shard.
    """
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative, at least one positive")
    text = F.coalesce(key.cast("string"), F.lit("\x00null"))
    scores = []
    for i, w in enumerate(weights):
        if w:
            h = F.shiftrightunsigned(F.xxhash64(text, F.lit(i)), 12)  # 52 bits, so that adding a half is exact and u never 1
            u = (h.cast("double") + F.lit(0.5)) * F.lit(2.0**-52)
            scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("s"), F.lit(-i).alias("i")))
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]).cast("int")


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """df with its shard: a narrow projection, no shuffle.  Nulls share a shard; equal keys always do."""
    return df.withColumn(shard, shard_of(F.col(key), weights))


def number_slots(rows: DataFrame, shard: str, key: str, slot: str = "slot") -> DataFrame:
    """rows with a gapless slot from 0 in each shard, in order of a bucket by the row's hash, the key, then the other columns.

    Repeated rows are counted before the shuffle and numbered as one run, so a key that holds a third of the rows is one
    row in the sort; rows of one key that differ elsewhere (texts without an id) spread over the buckets.  The offsets of
    the buckets are at most SLOT_BUCKETS rows a shard and are broadcast.
    """
    names = rows.columns
    b, n, before, base, i = (fresh(names, x) for x in ("slot_bucket", "slot_n", "slot_before", "slot_base", "slot_i"))
    bucketed = rows.withColumn(b, F.pmod(F.xxhash64(*names), F.lit(SLOT_BUCKETS)).cast("int"))
    runs = bucketed.groupBy(*names, b).agg(F.count(F.lit(1)).alias(n))
    w = Window.partitionBy(shard, b).orderBy(*[F.col(c).asc_nulls_first() for c in [key, *[x for x in names if x not in (key, shard)]]])
    numbered = runs.withColumn(before, F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = bucketed.groupBy(shard, b).agg(F.count(F.lit(1)).alias(n))
    up_to = Window.partitionBy(shard).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(shard, b, F.coalesce(F.sum(n).over(up_to), F.lit(0)).alias(base))
    return (
        numbered.join(F.broadcast(bases), [shard, b])
        .withColumn(i, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
        .select(*names, (F.col(base) + F.coalesce(F.col(before), F.lit(0)) + F.col(i)).alias(slot))
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8, 8 for a null text, whose crc is that of the empty text.  Null ids share one
    shard.  Repeated rows get a slot each.  grown_shard is the shard if one more of weight 1 were added.
    """
    ws = list(weights or [1.0] * n_shards)
    key = F.col("doc_id")
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        shard_of(key, ws).alias("shard"),
        shard_of(key, [*ws, 1.0]).alias("grown_shard"),
    )
    return number_slots(rows, "shard", "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
