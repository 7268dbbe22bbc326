"""Reads of one table: scans, ids, gets, keys, statistics; over documents or over a typed table in place."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import kind_of_table, label_of_table
from ..plans import TypedResolver, VariantResolver, compile_predicate
from ..plans.predicates import is_noop

#: Ids given as a list go into the filter up to this many; more are joined.
INLINE_IDS = 1000


class DocTable:
    """A named bag of documents: a DataFrame with _id, doc (VARIANT) and _seq; of equal ids the largest _seq is latest."""

    def __init__(self, rows: DataFrame, name: str, columns: list[str] | None = None):
        self.rows, self.name, self.columns = rows, name, list(columns or [])
        self.kind, self.label = kind_of_table(name), label_of_table(name)
        self.resolver = VariantResolver(label=self.label)

    def versions(self, which: str = "all") -> DataFrame:
        """all: the bag, each id as often as it was stored; latest: of each id the row stored last."""
        if which == "all":
            return self.rows
        if which != "latest":
            raise ValueError(which)
        return self.rows.groupBy("_id").agg(F.max_by("doc", "_seq").alias("doc"), F.max("_seq").alias("_seq"))

    def filtered(self, pred=None, versions: str = "all") -> DataFrame:
        rows = self.versions(versions)
        return rows if is_noop(pred) else rows.filter(compile_predicate(pred, self.resolver))

    def scan(self, pred=None, versions: str = "all") -> DataFrame:
        """_id and doc of the rows that match, in no order.  The row's _id is a column of its own and goes before any in doc."""
        return self.filtered(pred, versions).select("_id", "doc")

    def scan_ids(self, pred=None, versions: str = "all") -> DataFrame:
        return self.filtered(pred, versions).select("_id")

    def scan_json(self, pred=None, versions: str = "all") -> DataFrame:
        """_id and the document as JSON text that begins with the row's _id; a key _id of its own is left out."""
        rows = self.filtered(pred, versions)
        is_object = F.schema_of_variant("doc").startswith("OBJECT")
        members = F.map_filter(F.try_variant_get("doc", "$", "map<string,variant>"), lambda k, _: k != "_id")
        rest = F.regexp_extract(F.to_json(members), r"(?s)^\{(.*)\}$", 1)
        own = F.regexp_extract(F.to_json(F.struct("_id")), r"(?s)^\{(.*)\}$", 1)
        with_id = F.concat(F.lit("{"), F.concat_ws(",", F.when(own != "", own), F.when(rest != "", rest)), F.lit("}"))
        return rows.select("_id", F.when(is_object, with_id).otherwise(F.to_json("doc")).alias("json"))

    def project(self, fields: dict[str, str], pred=None, versions: str = "all") -> DataFrame:
        """_id and named fields as variants; only these fields leave the scan."""
        rows = self.filtered(pred, versions)
        return rows.select("_id", *[_column(self.resolver.value(path)).alias(name) for name, path in fields.items()])

    def get(self, row_id: str) -> DataFrame:
        """The latest document of an id: one row or none, without the id."""
        return self.rows.filter(F.col("_id") == F.lit(row_id)).orderBy(F.desc("_seq")).limit(1).select("doc")

    def get_many(self, ids, key: str = "_id", order: str | None = None) -> DataFrame:
        """A row for each wanted id, in their order: pos, _id, doc, error (not found), doc null then.

        ids is a list, or a DataFrame with the id column key and an optional column order for the position.
        """
        spark = self.rows.sparkSession
        if not isinstance(ids, DataFrame):
            wanted, ordered = [str(x) for x in ids], True
            ids = spark.createDataFrame(list(enumerate(wanted)), "pos bigint, _id string")
            rows = self.rows.filter(F.col("_id").isin(wanted)) if len(wanted) <= INLINE_IDS else self.rows
        else:
            pos = F.col(order).cast("long") if order else F.lit(None).cast("long")
            ids, rows = ids.select(pos.alias("pos"), F.col(key).cast("string").alias("_id")), self.rows
            ordered = order is not None
        latest = DocTable(rows.join(ids.select("_id").distinct(), "_id", "left_semi"), self.name).versions("latest").select("_id", "doc", F.lit(True).alias("there"))
        out = ids.join(latest, "_id", "left").select("pos", "_id", "doc", F.when(F.col("there").isNull(), F.concat(F.lit("no row "), F.coalesce("_id", F.lit("null")))).alias("error"))
        return out.orderBy("pos") if ordered else out

    def keys(self) -> DataFrame:
        """Distinct ids in byte order."""
        return self.rows.select("_id").distinct().orderBy("_id")

    def key_range(self, start: str | None = None, end: str | None = None, prefix: str | None = None) -> DataFrame:
        """_id and doc of the rows whose id is start or more, less than end and begins with prefix, by id in byte order."""
        return self.rows.filter(_in_range(F.col("_id"), start, end, prefix)).select("_id", "doc").orderBy("_id")

    def column_defs(self) -> list[str]:
        return list(self.columns)

    def fetch(self, ids: DataFrame, key: str = "row_id") -> DataFrame:
        """_id and doc of the rows whose id is listed (an index lookup's result)."""
        return self.rows.join(ids.select(F.col(key).alias("_id")).distinct(), "_id", "left_semi").select("_id", "doc")


def _in_range(key: Column, start: str | None, end: str | None, prefix: str | None) -> Column:
    """The condition, in forms that a scan can push."""
    parts = [c for x, c in ((start, key >= F.lit(start)), (end, key < F.lit(end)), (prefix, key.startswith(prefix or ""))) if x is not None]
    return functools.reduce(lambda a, b: a & b, parts, F.lit(True))


def _column(value) -> Column:
    return value.v if hasattr(value, "v") else value.col


class TypedTable:
    """A table with columns, used in place; its predicates reach the scan as pushed filters."""

    def __init__(self, rows: DataFrame, id_col: str, name: str):
        self.rows, self.id_col, self.name = rows, id_col, name
        self.kind, self.label = kind_of_table(name), label_of_table(name)
        self.resolver = TypedResolver(rows.schema, id_col=id_col, label=self.label)

    def filtered(self, pred=None) -> DataFrame:
        return self.rows if is_noop(pred) else self.rows.filter(compile_predicate(pred, self.resolver))

    def scan(self, pred=None) -> DataFrame:
        return self.filtered(pred)

    def scan_ids(self, pred=None) -> DataFrame:
        return self.filtered(pred).select(F.col(self.id_col).cast("string").alias("_id"))

    def keys(self) -> DataFrame:
        return self.rows.select(F.col(self.id_col).cast("string").alias("_id")).distinct().orderBy("_id")

    def key_range(self, start: str | None = None, end: str | None = None, prefix: str | None = None) -> DataFrame:
        """The rows whose id as text is start or more, less than end and begins with prefix, by id in byte order."""
        key = F.col(self.id_col).cast("string")
        return self.rows.filter(_in_range(key, start, end, prefix)).orderBy(key)

    def get_many(self, ids, key: str = "_id", order: str | None = None) -> DataFrame:
        """A row for each wanted id, in their order: _pos, _wanted, the table's columns, error (no row), columns null then.

        ids is a list, or a DataFrame with the id column key and an optional column order for the position.
        """
        if not isinstance(ids, DataFrame):
            kind = self.rows.schema[self.id_col].dataType.simpleString()
            ids, key, order = self.rows.sparkSession.createDataFrame(list(enumerate(ids)), f"pos bigint, _id {kind}"), "_id", "pos"
        pos = F.col(order).cast("long") if order else F.lit(None).cast("long")
        want = ids.select(pos.alias("_pos"), F.col(key).alias("_wanted"))
        out = want.join(self.rows.withColumn("_there", F.lit(True)), F.col("_wanted") == F.col(self.id_col), "left")
        error = F.when(F.col("_there").isNull(), F.concat(F.lit("no row "), F.coalesce(F.col("_wanted").cast("string"), F.lit("null"))))
        out = out.withColumn("error", error).drop("_there")
        return out.orderBy("_pos") if order else out

    def column_defs(self) -> list[str]:
        return list(self.rows.columns)

    def documents(self) -> DocTable:
        """The same rows as documents: each a VARIANT of its columns, null columns left out."""
        doc = F.parse_json(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.rows.columns])))
        return DocTable(self.rows.select(F.col(self.id_col).cast("string").alias("_id"), doc.alias("doc"), F.lit(0).cast("long").alias("_seq")), self.name, self.rows.columns)
