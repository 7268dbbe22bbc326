"""A store of named tables of JSON documents under one root folder."""

from __future__ import annotations

import urllib.parse
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import EDGE, VERTEX, kind_of_table, label_of_table
from ..plans import index_path
from ..plans.predicates import compile_leaf
from ..plans.resolve import IndexedValue, VariantResolver, VariantValue
from .files import Catalog, Conflict, Files
from .table import DocTable

ROWS = "_id string, doc variant, _seq bigint"
#: A load's number stands above its rows' positions in _seq.
POSITION_BITS = 40
#: Compaction is due when more of the stored rows are deleted, or when a table consists of more loads.
DELETED_RATIO, MOST_LOADS = 0.2, 32
#: Rows a file at most; where rows are shuffled before they are written, files also get Spark's advisory partition size.
FILE_ROWS = 4_000_000
#: An anti join broadcasts the ids of tables up to this many rows and bytes of files; ids in sequence take next to no bytes there.
SMALL_ROWS, SMALL_BYTES = 500_000, 8 << 20


class TableNotFound(KeyError):
    pass


class _Stale(RuntimeError):
    """What a load has read of a table is no longer so."""


class IndexExists(ValueError):
    pass


class IndexNotFound(KeyError):
    pass


@dataclass
class LoadResult:
    """What a load did; rejected has the rows that no table took, with the reason."""

    load: int
    inserted: int
    rejected: DataFrame
    valid: DataFrame

    def skipped(self) -> int:
        """Valid rows that were left out as their id was there; counted when asked for, by a pass over the input."""
        return self.valid.count() - self.inserted


class DocStore:
    """Opens or creates a store.  Every change writes new files and then commits one catalog version, so readers see whole
    changes only and a lost job leaves nothing but unused files.  Of two writers at once the later one's change is made again
    on what the earlier has left, or `Conflict` is raised after some tries."""

    def __init__(self, spark: SparkSession, root: str, create: bool = True):
        self.spark, self.files = spark, Files(spark, root)
        self.catalog = Catalog(self.files)
        if not self.catalog.versions():
            if not create:
                raise FileNotFoundError(f"no store at {root}")
            self.catalog.commit(-1, {"tables": {}, "indexes": [], "loads": 0})

    @classmethod
    def open(cls, spark: SparkSession, root: str, create: bool = False) -> DocStore:
        return cls(spark, root, create)

    def _change(self, change, tries: int = 5):
        for left in reversed(range(tries)):
            seen, state = self.catalog.load()
            out = change(state)
            try:
                self.catalog.commit(seen, state)
                return out
            except Conflict:
                if not left:
                    raise

    def state(self) -> dict:
        return self.catalog.load()[1]

    # ---- tables

    @staticmethod
    def check_name(name: str) -> None:
        if not isinstance(name, str) or len(name) < 2:
            raise ValueError(f"a table name has a two-character kind and a label: {name!r}")

    def create_table(self, name: str, columns: list[str] | None = None) -> DocTable:
        """The table, made if it isn't there; an existing one keeps its columns."""
        self.check_name(name)
        if name not in self.state()["tables"]:
            self._change(lambda s: s["tables"].setdefault(name, _new_table(columns)))
        return self.table(name)

    def tables(self) -> list[str]:
        """Names in byte order."""
        return sorted(self.state()["tables"], key=lambda n: n.encode())

    def tables_df(self) -> DataFrame:
        rows = [(n, t["uuid"], t["columns"]) for n, t in self.state()["tables"].items()]
        return self.spark.createDataFrame(rows, "name string, uuid string, columns array<string>").orderBy("name")

    def _info(self, name: str, state: dict | None = None) -> dict:
        tables = (state or self.state())["tables"]
        if name not in tables:
            raise TableNotFound(name)
        return tables[name]

    def table(self, name: str) -> DocTable:
        info = self._info(name)
        return DocTable(self._rows(info), name, info["columns"])

    def _rows(self, info: dict) -> DataFrame:
        """The live rows: all loads' files in one scan, less the deleted ids where any are."""
        return self._less(self._stored(info), info["deletes"], "_id")

    def _stored(self, info: dict) -> DataFrame:
        return self._read(info["loads"])

    def _read(self, loads: list[str]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], "_id string, doc string, _seq bigint").select("_id", F.try_parse_json("doc").alias("doc"), "_seq")
        return self.spark.read.schema(ROWS).parquet(*[self.files.at(p) for p in loads])

    def _less(self, rows: DataFrame, deletes: list[str], key: str, own: str = "_id") -> DataFrame:
        """rows (key, _seq, ..) less those that a delete lists (own, _upto) with a later number."""
        if not deletes:
            return rows
        gone = self.spark.read.schema(f"{own} string, _upto bigint").parquet(*[self.files.at(p) for p in deletes])
        gone = gone.groupBy(F.col(own).alias("gone")).agg(F.max("_upto").alias("_upto"))
        return rows.join(gone, (F.col(key) == F.col("gone")) & (F.col("_seq") <= F.col("_upto")), "left_anti")

    def drop(self, name: str) -> None:
        """Removes a table, its files and its indexes."""
        info = self._info(name)
        entries = [i for i in self.state()["indexes"] if i["table"] == name]

        def change(s):
            s["tables"].pop(name, None)
            s["indexes"] = [i for i in s["indexes"] if i["table"] != name]

        self._change(change)
        for p in [*info["loads"], *info["deletes"], *(p for e in entries for p in _index_files(e))]:
            self.files.delete(self.files.at(p))

    def load_count(self, name: str) -> int:
        """How many loads a table consists of; 0 if there is no such table."""
        return len(self.state()["tables"].get(name, {"loads": []})["loads"])

    def column_names(self, dedupe: bool = True) -> DataFrame:
        """column_name of all tables; each once, or as often as tables declare it."""
        rows = [(c,) for t in self.state()["tables"].values() for c in t["columns"]]
        out = self.spark.createDataFrame(rows, "column_name string")
        return out.distinct() if dedupe else out

    def labels(self, edges: bool = False, strip: bool = True) -> DataFrame:
        """label of the edge tables, or of the vertex tables; with or without the prefix."""
        prefix = EDGE if edges else VERTEX
        rows = [(label_of_table(n) if strip else n,) for n in self.tables() if kind_of_table(n) == prefix]
        return self.spark.createDataFrame(rows, "label string")

    def ids_for_label(self, name: str) -> DataFrame:
        """All ids of a table by its full name; none if there is no such table."""
        try:
            return self.table(name).scan_ids()
        except TableNotFound:
            return self.spark.createDataFrame([], "_id string")

    # ---- writes

    def insert(self, name: str, rows: DataFrame, id_col: str = "_id", doc: str = "doc", order: str | None = None) -> LoadResult:
        """Stores rows as they come, ids that are there already included; a keyed get then finds the latest."""
        own = rows.select(F.lit(name).alias("table_name"), F.col(id_col).alias("id"), F.col(doc).alias("data"), *([F.col(order).alias("position")] if order else []))
        return self._bulk_load(own, "position" if order else None, False, names=[name])

    def bulk_load(self, rows: DataFrame, order: str | None = None, if_absent: bool = True, tries: int = 5, file_rows: int = FILE_ROWS) -> LoadResult:
        """Loads (table_name, id, data) rows into their tables, made where needed, in one commit.

        data is JSON text, a VARIANT or a struct.  With if_absent, ids that a table has when the load starts are left out;
        an id that comes several times within the load is stored as often, and the row with the largest order is latest
        (without order, the one with the largest hash of its data).  Rows that no table can take (no id, a name under two
        characters, malformed JSON) are returned with a reason and don't keep the others from being stored.

        Only the tables that the load names are read; what it costs goes with them and the load, not with the store.  If a
        table changes between that reading and the commit, the load is made again on the changed table, tries times at most.
        Stored indexes of the tables get the new rows' entries in the same commit.
        """
        return self._bulk_load(rows, order, if_absent, tries, file_rows)

    def _bulk_load(self, rows: DataFrame, order: str | None, if_absent: bool, tries: int = 5, file_rows: int = FILE_ROWS, names: list | None = None) -> LoadResult:
        """names: the tables that the rows name, where that is known without a pass over them."""
        kind = rows.schema["data"].dataType.typeName()
        text_in = kind == "string"
        doc = F.try_parse_json("data") if text_in else F.col("data") if kind == "variant" else F.parse_json(F.to_json("data"))
        pos = F.col(order).cast("long") if order else F.shiftrightunsigned(F.xxhash64(F.col("data") if text_in else F.to_json("data")), 64 - POSITION_BITS)
        rows = rows.select("table_name", F.col("id").cast("string").alias("_id"), doc.alias("doc"), (F.col("data") if text_in else F.to_json("data")).alias("text"), pos.alias("pos"))
        reason = F.when(F.col("_id").isNull(), "no id").when(F.col("table_name").isNull() | (F.char_length("table_name") < 2), "a table name has two characters at least")
        if text_in:  # what isn't text is JSON; to test it too would make each document once more
            reason = reason.when(F.col("text").isNotNull() & F.col("doc").isNull(), "malformed JSON")
        if order:
            reason = reason.when((F.col("pos") < 0) | (F.col("pos") >= 1 << POSITION_BITS), "position out of range")
        marked = rows.withColumn("reason", reason)
        rejected = marked.filter(F.col("reason").isNotNull()).select("table_name", F.col("_id").alias("id"), F.col("text").alias("data"), "reason")
        good = marked.filter(F.col("reason").isNull())

        if names is None:
            names = [r[0] for r in rows.select("table_name").distinct().collect()]
        for left in reversed(range(tries)):
            try:
                load, inserted = self._load(good, names, if_absent, file_rows)
                return LoadResult(load, inserted, rejected, good)
            except _Stale as e:
                if not left:
                    raise Conflict(f"{e} was changed by others {tries} times while rows were loaded") from None
        raise ValueError("at least one try is needed")

    def _load(self, good: DataFrame, names: list, if_absent: bool, file_rows: int) -> tuple[int, int]:
        """One try of a load: its number and how many rows it stored."""
        tables = self.state()["tables"]
        seen = {n: tables[n] for n in names if n in tables}
        have, stored = None, []
        for n, info in seen.items():
            if if_absent and info["loads"]:
                own = self._rows(info).select(F.lit(n).alias("table_name"), "_id")
                have = own if have is None else have.unionByName(own)
                stored += info["loads"]
        if have is not None:
            # merge: else the planner, which goes by the files' bytes, broadcasts too; a merge spills what a task can't hold
            good = good.join(have.hint("broadcast" if self._is_small(stored) else "merge"), ["table_name", "_id"], "left_anti")
        load = self._change(_next_load)
        path = f"loads/{load:08d}-{uuid.uuid4().hex[:8]}"
        seq = F.lit(load << POSITION_BITS).cast("long") + F.coalesce("pos", F.lit(0))
        out = good.select("table_name", "_id", "doc", seq.alias("_seq"))
        if len(names) > 1:  # else each task would write a file for each table
            out = out.hint("rebalance", F.col("table_name"))
        out.write.partitionBy("table_name").option("compression", "zstd").option("maxRecordsPerFile", file_rows).parquet(self.files.at(path))
        counts = self._partition_counts(path)
        parts = [(i["table"], i["field"], self._write_index(i, [folder])) for n, folder, _ in counts for i in self.state()["indexes"] if i["table"] == n and i["stored"]]

        def commit(s):
            for n, _, _ in counts:
                now, then = (x.get(n) or _new_table(None) for x in (s["tables"], seen))
                if now["deletes"] != then["deletes"] or (if_absent and now["loads"] != then["loads"]):
                    raise _Stale(n)
            _add_load(s, path, counts)
            for name, field, part in parts:
                for i in s["indexes"]:
                    if (i["table"], i["field"]) == (name, field):
                        i["parts"].append(part)

        try:
            self._change(commit)
        except _Stale:
            for p in [path, *(part["path"] for _, _, part in parts)]:
                self.files.delete(self.files.at(p))
            raise
        return load, sum(c for _, _, c in counts)

    def _is_small(self, loads: list[str]) -> bool:
        """Whether a task can hold the ids of all rows of some loads; rows are counted by the files' footers."""
        return sum(self.files.size(self.files.at(p)) for p in loads) <= SMALL_BYTES and self._read(loads).count() <= SMALL_ROWS

    def _partition_counts(self, path: str) -> list[tuple[str, str, int]]:
        """(table, folder, rows) of a load; as many rows as there are tables come to the driver."""
        at = self.files.at(path)
        folders = [n for n in self.files.names(at) if n.startswith("table_name=")]
        if not folders:
            return []
        read = self.spark.read.option("basePath", at).schema(f"{ROWS}, table_name string").parquet(at)
        counts = {r["table_name"]: r["count"] for r in read.groupBy("table_name").count().collect()}
        unescape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        return [(n, f"{path}/{folder}", counts.get(n, 0)) for folder in folders for n in [unescape(folder[len("table_name=") :])]]

    def delete(self, name: str, ids) -> None:
        """Deletes all rows that the ids have now; a list or a DataFrame with _id.  The same ids may be stored anew later."""
        self._info(name)
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(str(x),) for x in ids], "_id string")
        load = self._change(_next_load)
        path = f"deletes/{load:08d}-{uuid.uuid4().hex[:8]}"
        ids.select(F.col("_id").cast("string").alias("_id"), F.lit((load << POSITION_BITS) - 1).cast("long").alias("_upto")).distinct().write.parquet(self.files.at(path))
        self._change(lambda s: self._info(name, s)["deletes"].append(path))

    def delete_range(self, name: str, start: str | None = None, end: str | None = None, prefix: str | None = None) -> None:
        """Deletes the rows whose id is start or more, less than end and begins with prefix, in one commit."""
        self.delete(name, self.table(name).key_range(start, end, prefix).select("_id"))

    def stats(self, name: str) -> DataFrame:
        """total, deleted, live rows and the deleted share of a table's files; one row."""
        info = self._info(name)
        total = self._stored(info).agg(F.count(F.lit(1)).alias("total"))
        live = self._rows(info).agg(F.count(F.lit(1)).alias("live"))
        both = total.withColumn("k", F.lit(1)).join(live.withColumn("k", F.lit(1)), "k")
        gone = F.col("total") - F.col("live")
        return both.select("total", gone.alias("deleted"), "live", F.when(F.col("total") > 0, gone / F.col("total")).otherwise(F.lit(0.0)).alias("ratio"))

    def compact(self, name: str, ratio: float = DELETED_RATIO, versions: str = "all", force: bool = False, most_loads: int = MOST_LOADS) -> bool:
        """Rewrites a table's live rows if more than ratio of the stored ones are deleted or it has more than most_loads loads.

        Whether it did.  versions="latest" also drops rows that a later one of the same id hides.  Stored indexes are
        written anew with it; if the table changes meanwhile, `Conflict` is raised and nothing is changed.
        """
        info = self._info(name)
        if not force and len(info["loads"]) <= most_loads and (not info["deletes"] or self.stats(name).first()["ratio"] <= ratio):
            return False
        path = f"loads/compact-{uuid.uuid4().hex[:12]}"
        rows = DocTable(self._rows(info), name).versions(versions).select("_id", "doc", "_seq").hint("rebalance")
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", FILE_ROWS).parquet(self.files.at(path))
        entries = [i for i in self.state()["indexes"] if i["table"] == name and i["stored"]]
        parts = {i["field"]: self._write_index(i, [path]) for i in entries}

        def change(s):
            if self._info(name, s) != info:
                raise Conflict(f"{name} changed while it was compacted")
            self._info(name, s).update(loads=[path], deletes=[])
            for i in s["indexes"]:
                if i["table"] == name:
                    i["parts"] = [parts[i["field"]]] if i["field"] in parts else []

        try:
            self._change(change)
        except Conflict:
            for p in [path, *(part["path"] for part in parts.values())]:
                self.files.delete(self.files.at(p))
            raise
        for p in [*info["loads"], *info["deletes"], *(p["path"] for i in entries for p in i["parts"])]:
            self.files.delete(self.files.at(p))
        return True

    # ---- secondary indexes

    def add_index(self, name: str, field: str) -> None:
        """Registers an index on a table's field, the table made if need be.  It is a view of the table until `store_index`."""
        self.check_name(name)
        index_path(field)

        def change(s):
            if any(i["table"] == name and i["field"] == field for i in s["indexes"]):
                raise IndexExists(f"{name}, {field}")
            s["tables"].setdefault(name, _new_table(None))
            s["indexes"].append({"table": name, "field": field, "deletes": [], "stored": False, "parts": []})

        self._change(change)

    def remove_index(self, name: str, field: str) -> None:
        entry = self._index(name, field)

        def change(s):
            s["indexes"] = [i for i in s["indexes"] if (i["table"], i["field"]) != (name, field)]

        self._change(change)
        for p in _index_files(entry):
            self.files.delete(self.files.at(p))

    def indexes(self) -> DataFrame:
        """label and field of each index; vertex tables by their label, others by their whole name."""
        rows = [(label_of_table(i["table"]) if kind_of_table(i["table"]) == VERTEX else i["table"], i["field"]) for i in self.state()["indexes"]]
        return self.spark.createDataFrame(sorted(rows), "label string, field string")

    def _index(self, name: str, field: str, state: dict | None = None) -> dict:
        state = state or self.state()
        self._info(name, state)
        for i in state["indexes"]:
            if i["table"] == name and i["field"] == field:
                return i
        raise IndexNotFound(f"{name}, {field}")

    def _index_entries(self, name: str, field: str, rows: DataFrame) -> DataFrame:
        """What an index holds of a table's rows, with the columns that lookups test."""
        t = DocTable(rows, name)
        value = VariantResolver(label=t.label, parse=index_path).value(field)
        col = value.v if isinstance(value, VariantValue) else F.try_parse_json(F.to_json(F.array(value.col)))
        if not isinstance(value, VariantValue):
            col = F.try_variant_get(col, "$[0]", "variant")
        return t.rows.select(col.alias("value"), F.col("_id").alias("row_id"), "_seq").select(*IndexedValue.columns(F.col("value")), "row_id", "_seq")

    def _indexed(self, name: str, field: str) -> DataFrame:
        """The live entries of an index: its stored parts, and a view of the loads that none covers."""
        state = self.state()
        entry, info = self._index(name, field, state), self._info(name, state)
        parts = [p for p in entry["parts"] if set(p["of"]) <= set(info["loads"])]
        covered = {x for p in parts for x in p["of"]}
        rest = [x for x in info["loads"] if x not in covered]
        rows = self._index_entries(name, field, self._read(rest)) if rest or not parts else None
        if parts:
            kept = self.spark.read.schema(f"{IndexedValue.COLUMNS}, row_id string, _seq bigint").parquet(*[self.files.at(p["path"]) for p in parts])
            rows = kept if rows is None else kept.unionByName(rows)
        return self._less(self._less(rows, info["deletes"], "row_id"), entry["deletes"], "row_id", "row_id")

    def index_rows(self, name: str, field: str) -> DataFrame:
        """label, field, value (VARIANT, null where the field is missing), row_id of an index."""
        return self._indexed(name, field).select(F.lit(label_of_table(name)).alias("label"), F.lit(field).alias("field"), "value", "row_id")

    def _write_index(self, entry: dict, loads: list[str]) -> dict:
        """A part of an index that covers some loads: under the table and field, in order of kind and value."""
        at = [urllib.parse.quote(entry[k], safe="") for k in ("table", "field")]
        path = f"indexes/table={at[0]}/field={at[1]}/{uuid.uuid4().hex[:12]}"
        rows = self._index_entries(entry["table"], entry["field"], self._read(loads))
        order = ["kind", "number", "text", "row_id"]
        rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(self.files.at(path))
        return {"path": path, "of": loads}

    def store_index(self, name: str, field: str) -> None:
        """Writes out what no part of an index covers yet; from then on loads add their rows' entries to it themselves."""
        info, entry = self._info(name), self._index(name, field)
        covered = {x for p in entry["parts"] for x in p["of"]}
        rest = [x for x in info["loads"] if x not in covered]
        part = self._write_index(entry, rest) if rest else None

        def change(s):
            i = self._index(name, field, s)
            i["stored"] = True
            if part and not any(set(part["of"]) & set(p["of"]) for p in i["parts"]):  # else another has stored it
                i["parts"].append(part)

        self._change(change)

    def delete_row_field(self, name: str, field: str, row_id: str) -> None:
        """Takes one row out of an index, whatever its value; the row stays.

        An id that isn't in the index changes nothing.  It stays out of the index, stored or not, until a row of that id is
        loaded anew.
        """
        self._index(name, field)
        load = self._change(_next_load)
        path = f"index-deletes/{uuid.uuid4().hex[:12]}"
        self.spark.createDataFrame([(row_id, (load << POSITION_BITS) - 1)], "row_id string, _upto bigint").coalesce(1).write.parquet(self.files.at(path))
        self._change(lambda s: self._index(name, field, s)["deletes"].append(path))

    def ids_by_label_field(self, name: str, field: str, value, op: str = "EQ") -> DataFrame:
        """row_id of one table's index entries whose value the operator matches."""
        return self._indexed(name, field).filter(compile_leaf(op, value, IndexedValue())[0]).select("row_id")

    def ids_by_field(self, field: str, value, op: str = "EQ") -> DataFrame:
        """The same over all tables with an index on field; an id of two tables comes twice."""
        out = None
        for i in self.state()["indexes"]:
            if i["field"] == field:
                own = self.ids_by_label_field(i["table"], field, value, op)
                out = own if out is None else out.unionByName(own)
        return self.spark.createDataFrame([], "row_id string") if out is None else out

    def close(self) -> None:
        """Nothing is held open or cached, so there is nothing to let go of; the store can be used on."""


def _index_files(entry: dict) -> list[str]:
    return [*entry["deletes"], *(p["path"] for p in entry["parts"])]


def _new_table(columns: list[str] | None) -> dict:
    return {"uuid": uuid.uuid4().hex, "columns": list(columns or []), "loads": [], "deletes": []}


def _next_load(state: dict) -> int:
    state["loads"] += 1
    return state["loads"]


def _add_load(state: dict, path: str, counts: list[tuple[str, str, int]]) -> None:
    for name, folder, _ in counts:
        state["tables"].setdefault(name, _new_table(None))["loads"].append(folder)
