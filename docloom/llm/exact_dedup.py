"""Exact deduplication against a persistent index of text digests, bucketed and sorted by hash."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, fresh, lookup, shared_dir, small, text_or_empty, written

BUCKETS = 64
#: Digests a bucket should hold at most, where an operator sizes an index for a table itself.
BUCKET_ROWS = 100_000


def digest(text: str = "text"):
    """SHA-256 of the UTF-8 text as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(text_or_empty(text), 256))


class DigestIndex:
    """Digests seen so far, a Parquet table bucketed and sorted by digest under a path.

    Each row is (digest, keep_id as text, batch).  New digests are found by a sort-merge anti join in which only the new
    side is shuffled; appending writes new files into the same buckets.  Any later session can open the path again; the number
    of buckets is the one that it was made with, as a file beside the data says.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._made_with(int(buckets))
        self.name = f"docloom_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id STRING, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )

    def _made_with(self, buckets: int) -> int:
        """The number of buckets in the file beside the data, which the first to open the path writes."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/index.json")
        fs = at.getFileSystem(conf)
        if not fs.exists(at):
            part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/index.json.{uuid.uuid4().hex}")
            out = fs.create(part, True)
            out.write(bytearray(json.dumps({"buckets": buckets}).encode()))
            out.close()
            if not fs.rename(part, at):  # another was first: its number counts
                fs.delete(part, False)
        stream = fs.open(at)
        try:
            return json.loads(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))["buckets"]
        finally:
            stream.close()

    def close(self) -> None:
        """Takes the table's name out of the session's catalog; the data stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Adds the digests of groups (digest, keep_id) that aren't in yet, so a batch that is run again adds nothing twice."""
        new = groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")
        out = new.select("digest", F.col("keep_id").cast("string").alias("keep_id"), F.lit(batch).alias("batch")).repartition(self.buckets, "digest")
        out.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/rows").saveAsTable(self.name)

    def new_rows(self, df: DataFrame, batch: str | None = None) -> DataFrame:
        """The rows of df whose digest isn't in the index by another batch: a sort-merge anti join, whatever the sizes."""
        known = self.rows()
        if batch is not None:
            known = known.filter(F.col("batch") != batch)
        return df.join(known.select("digest").hint("merge"), "digest", "left_anti")

    def admit_groups(self, groups: DataFrame, batch: str) -> DataFrame:
        """The groups (digest, keep_id, ..) that are new, written; and indexes them under the batch's name.

        Run again with the same name after a failure, it gives the same groups and adds none, for what a batch itself has
        appended doesn't count as known to it.
        """
        admitted = written(self.new_rows(groups, batch), "admitted")
        self.append(admitted, batch)
        return admitted

    def admit(self, docs: DataFrame, batch: str, key: str = "doc_id") -> DataFrame:
        """The documents of a batch that are new, one of each group of equal texts, and indexes them (see admit_groups).

        The row with the largest key stays, with all its columns; null and empty texts are equal; null keys lose to others;
        of rows that repeat key and text one stays, which one is open.  A batch without rows adds nothing.  Only (key,
        digest) pairs are shuffled, merged before the shuffle; texts stay where they are while the list of digests to drop or
        choose from is small, and are met as `lookup` does beyond that.
        """
        names = docs.columns
        d, k, n, r, new = (fresh(names, x) for x in ("digest", "group_keep", "group_n", "group_repeats", "group_new"))
        pairs = written(repeats(docs.select(F.col(key).alias("doc_id"), digest().alias("digest"))), "digests")
        groups = written(group_equal(pairs), "digest-groups")
        admitted = self.admit_groups(groups, batch)
        known = groups.join(admitted.select("digest"), "digest", "left_anti").withColumn("new", F.lit(False))
        copied = admitted.filter("group_size > 1").withColumn("new", F.lit(True))
        listed = known.unionByName(copied).select(F.col("digest").alias(d), F.col("keep_id").alias(k), F.col("group_size").alias(n), F.col("repeats").alias(r), F.col("new").alias(new))
        listed = written(listed, "listed-digests")
        n_listed, most = listed.agg(F.count(F.lit(1)), F.max(r)).first()
        marked = docs.withColumn(d, digest())
        marked = marked.join(F.broadcast(listed), d, "left") if small(listed, n_listed) is not listed else lookup(marked, listed, d, n, docs.count())
        discard(pairs)
        stay = marked.filter(F.col(n).isNull() | (F.col(new) & F.col(key).eqNullSafe(F.col(k))))
        if (most or 1) == 1:
            return stay.select(*names)
        once = stay.filter(F.coalesce(F.col(r), F.lit(1)) == 1)
        again = stay.filter(F.col(r) > 1).dropDuplicates([d, key])  # a row for each group whose kept row repeats
        return once.select(*names).unionByName(again.select(*names))


def repeats(rows: DataFrame) -> DataFrame:
    """doc_id, digest, r: how often the pair occurs; partial aggregates go over the shuffle, not the rows."""
    return rows.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("r"))


def group_equal(pairs: DataFrame) -> DataFrame:
    """digest, keep_id (largest doc_id), repeats (rows of that id), group_size, of pairs (doc_id, digest, r)."""
    top = pairs.groupBy("digest").agg(F.max(F.struct("doc_id", "r")).alias("x"), F.sum("r").alias("group_size"))
    return top.select("digest", F.col("x.doc_id").alias("keep_id"), F.col("x.r").alias("repeats"), "group_size")


def _own_index(docs: DataFrame, n: int) -> DigestIndex:
    spark = docs.sparkSession
    return DigestIndex(spark, f"{shared_dir(spark)}/docloom-digest-index-{uuid.uuid4().hex}", max(8, min(4096, n // BUCKET_ROWS)))


def dedup_report(docs: DataFrame, index: DigestIndex | None = None, batch: str = "documents") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The table's digests are admitted to the index (one of its own, empty at first, if none is given) by a sort-merge anti
    join, and every document looks its digest up in what the batch has admitted, again by sort-merge; digests of a large
    share of the rows are looked up in a bounded broadcast table.  Texts that the index knew before keep its row: kept is
    false for all of theirs, keep_id is the indexed one.  Null ids lose to any id.  Of rows that repeat doc_id and text one
    is kept.
    """
    pairs = written(repeats(docs.select("doc_id", digest().alias("digest"))), "digests")
    n = pairs.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
    own = index or _own_index(docs, n)
    groups = written(group_equal(pairs), "digest-groups")
    admitted = own.admit_groups(groups, batch).withColumn("new", F.lit(True))
    known = groups.join(admitted.select("digest"), "digest", "left_anti")
    if index:
        before = own.rows().select("digest", F.col("keep_id").cast(docs.schema["doc_id"].dataType).alias("keep_id"))
        admitted = admitted.unionByName(known.drop("keep_id").join(before, "digest").withColumn("new", F.lit(False)))
    found = lookup(pairs, admitted.select("digest", "keep_id", "group_size", "new").hint("merge"), "digest", "group_size", n)
    found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r"))).alias("nth"))
    kept = F.col("new") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    own.close() if index is None else None
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


REPORT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (g ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs less the copies, as `DigestIndex.admit` with an index of their own: the row with the largest doc_id stays, once."""
    index = _own_index(docs, docs.count())
    out = index.admit(docs, "documents")
    index.close()
    return out
