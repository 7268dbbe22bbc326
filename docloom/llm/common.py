"""Helpers that several operators share: the shared folder, written tables, skew-safe lookups."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds more than one row in HOT_SHARE is hot.  There can be at most HOT_SHARE such keys, so the table of hot
#: keys has a proven bound and may be broadcast.
HOT_SHARE = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where none is set, a session whose executors are threads of the driver gets a temporary one; any other is refused, for
    a folder of one machine would lose what the executors of other machines write.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/docloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a written table that nothing reads any more; any other DataFrame is left alone."""
    path = _paths.pop(df, None)
    if path:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def give_back() -> None:
    """Returns to the system what this process has freed; Arrow's pool and the C heap would keep it for later."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow or mapInPandas, that gives memory back between batches and at its end.

    Workers are used again by the operators behind this one, and what they keep adds to what those and the JVM need.
    """

    def each(batches: Iterator) -> Iterator:
        for b in batches:
            yield b
            del b
            give_back()

    def to_end(batches: Iterator) -> Iterator:
        try:
            yield from run(each(batches))
        finally:
            gc.collect()
            give_back()

    return to_end


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files are; the folder must be there on every node, or be another one by DOCLOOM_TOKENIZERS."""
    folder = os.environ.get("DOCLOOM_TOKENIZERS", "/opt/tokenizers")
    return os.path.join(folder, name)


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name that none of those taken equals, as Spark compares names."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id as text, the basis of the held-out folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """rows left-joined to table on key (unique in table, never null), skewed keys included.

    weight is the column of table that says how many rows have the key.  Keys with more than n_rows / HOT_SHARE rows are
    looked up in a broadcast table of at most HOT_SHARE rows; only the others are shuffled.
    """
    hot_from = max(1000, n_rows // HOT_SHARE)
    others = [c for c in table.columns if c != key]
    hot = table.filter(F.col(weight) > hot_from)  # the weights add up to n_rows, so there are fewer than HOT_SHARE
    cold = table.filter(F.col(weight) <= hot_from)
    seen = fresh([*rows.columns, *table.columns], "is_hot")
    marked = rows.join(F.broadcast(hot.withColumn(seen, F.lit(True))), key, "left")
    names = [*rows.columns, *others]
    at_hot = marked.filter(F.col(seen)).select(*names)
    at_cold = marked.filter(F.col(seen).isNull()).select(*rows.columns).join(cold, key, "left").select(*names)
    return at_hot.unionByName(at_cold)


#: A table of keys is broadcast up to so many rows, counted first; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def text_key(text: str = "text"):
    """A 64-bit hash of the text, that tells rows apart which share an id; null counts as empty."""
    return F.xxhash64(text_or_empty(text))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs less the rows whose (doc_id, text_key) is in ids (columns id, t); null ids match null ids.

    Texts stay where they are while the list is small; a list over BROADCAST_ROWS is met by a shuffle.
    """
    listed = written(ids.select("id", "t").distinct(), "dropped-ids")
    i, t = fresh(docs.columns, "dropped_id"), fresh(docs.columns, "dropped_t")
    listed = small(listed.select(F.col("id").alias(i), F.col("t").alias(t)), listed.count())
    k = fresh(docs.columns, "text_key")
    return docs.withColumn(k, text_key()).join(listed, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(k) == F.col(t)), "left_anti").drop(k)


def piece_of(text: Column, max_chars: int, by: Column) -> Column:
    """The text, or of one over max_chars one of its pieces of max_chars characters, drawn by the hash of `by`."""
    n = F.ceil(F.char_length(text) / F.lit(max_chars)).cast("long")
    at = F.pmod(F.xxhash64(by, F.lit(17)), F.greatest(n, F.lit(1).cast("long")))
    return F.substring(text, (at * max_chars + 1).cast("int"), F.lit(max_chars))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, label) of at most per_class documents of each class 0 and 1, and how many ids each stands for.

    The sample is the ids with the smallest hash among those that have both a label and a document, so it depends on the
    rows alone.  learn is a condition on doc_id that says which labels may be learnt.  Ids with several labels count with
    the largest, ids with several texts with the one of the smallest hash; null ids and labels are left out.  Only ids are
    shuffled, and texts of the ids that are chosen.  per_class is a parameter of the operators that fit.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    known = written(known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labels")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = known.filter("label = 0").orderBy(*order).limit(per_class).unionByName(known.filter("label = 1").orderBy(*order).limit(per_class))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    one = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    return one.select("doc_id", "text", "label"), {k: v / min(v, per_class) for k, v in n.items()}
