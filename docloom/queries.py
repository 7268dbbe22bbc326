"""One query for each operator, over the given Parquet tables, and the SQL that gives the same rows."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .functions.scalar import field_key, field_key_parts, fnv1a, kind_of_table, label_of_table, location, pad_six, partition_of, position_key, reverse_key, table_key
from .functions.scratch import scratch_dir
from .operators import DocStore, DocTable, IndexExists, TypedTable
from .operators.files import Files
from .plans import And, Cond, Not, Or
from .plans.paths import local_path, namespace_of, normalize_path
from .plans.predicates import required_fields
from .sources import distinct_integers, random_documents, read_documents, read_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def typed(spark: SparkSession, sf: str, name: str, key: str, table: str | None = None) -> TypedTable:
    return TypedTable(read(spark, sf, name), key, table or f"v_{name}")


def _documents(events: DataFrame, *fields) -> DocTable:
    doc = F.parse_json(F.to_json(F.struct(*fields)))
    return DocTable(events.select(F.col("event_id").cast("string").alias("_id"), doc.alias("doc"), F.col("event_id").alias("_seq")), "e_Event")


def docs_e(spark: SparkSession, sf: str) -> DocTable:
    """Events as documents; event_type is missing where it is error."""
    e = read(spark, sf, "events")
    return _documents(e, "user_id", "value", F.from_json("props", "k int").alias("props"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))


def docs_m(spark: SparkSession, sf: str) -> DocTable:
    """Documents whose field mix is a text, a number, true or missing."""
    e, k = read(spark, sf, "events"), F.col("event_id") % 4
    mix = (
        F.when(k == 0, F.to_json(F.struct(F.col("user_id").cast("string").alias("mix"))))
        .when(k == 1, F.to_json(F.struct(F.col("user_id").alias("mix"))))
        .when(k == 2, F.lit('{"mix":true}'))
        .otherwise(F.lit("{}"))
    )
    return DocTable(e.select(F.col("event_id").cast("string").alias("_id"), F.parse_json(mix).alias("doc"), F.col("event_id").alias("_seq")), "e_Mixed")


def docs_a(spark: SparkSession, sf: str) -> DocTable:
    """Documents with a list of a text, a number and a null."""
    e = read(spark, sf, "events")
    text = F.concat(F.lit('{"tags":['), F.to_json(F.array("event_type")).substr(F.lit(2), F.char_length("event_type") + 2), F.lit(","), F.col("user_id").cast("string"), F.lit(",null]}"))
    return DocTable(e.select(F.col("event_id").cast("string").alias("_id"), F.parse_json(text).alias("doc"), F.col("event_id").alias("_seq")), "e_Tagged")


def ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("_id").cast("long").alias("id"))


# ---- scans and predicates


@query("SELECT event_id AS id, user_id, event_type FROM events")
def scan_all(spark, sf):
    return typed(spark, sf, "events", "event_id").scan().select(F.col("event_id").alias("id"), "user_id", "event_type")


@query("SELECT event_id AS id FROM events WHERE value > 100")
def scan_ids(spark, sf):
    return ids(typed(spark, sf, "events", "event_id").scan_ids(Cond("value", "GT", 100)))


@query("SELECT event_id AS id, user_id, NULLIF(event_type, 'error') AS event_type FROM events")
def scan_documents(spark, sf):
    got = docs_e(spark, sf).project({"user_id": "user_id", "event_type": "event_type"})
    return got.select(F.col("_id").cast("long").alias("id"), F.col("user_id").cast("long").alias("user_id"), F.col("event_type").cast("string").alias("event_type"))


@query("SELECT event_id AS id, CAST(event_id AS VARCHAR) AS inner_id FROM events")
def scan_id_injection(spark, sf):
    got = docs_m(spark, sf).scan_json()
    return got.select(F.col("_id").cast("long").alias("id"), F.get_json_object("json", "$._id").alias("inner_id"))


def _event_query(name: str, sql: str, pred, table=None) -> None:
    def run(spark, sf):
        t = table(spark, sf) if table else typed(spark, sf, "events", "event_id")
        return ids(t.scan_ids(pred))

    run.__name__ = name
    query(f"SELECT event_id AS id FROM events WHERE {sql}")(run)


for _name, _sql, _pred, *_table in [
    ("pred_eq_str", "event_type = 'click'", Cond("event_type", "EQ", "click")),
    ("pred_eq_null", "NULLIF(event_type,'error') IS NULL", Cond("event_type", "EQ", None), docs_e),
    ("pred_eq_type_mismatch", "event_id % 4 = 1 AND user_id = 5", Cond("mix", "EQ", 5), docs_m),
    ("pred_eq_object", "CAST(json_extract(props,'$.k') AS BIGINT) = 7", Cond("props", "EQ", {"k": 7}), docs_e),
    ("pred_neq", "NULLIF(event_type,'error') IS NULL OR event_type <> 'click'", Cond("event_type", "NEQ", "click"), docs_e),
    ("pred_neq_mixed", "event_id % 4 = 3 OR (event_id % 4 = 1 AND user_id <> 5)", Cond("mix", "NEQ", 5), docs_m),
    ("pred_gt", "value > 250", Cond("value", "GT", 250)),
    ("pred_gt_mixed", "CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 1 END > 50", Cond("mix", "GT", 50), docs_m),
    ("pred_gte", "user_id >= 100", Cond("user_id", "GTE", 100)),
    ("pred_lt", "value < 5", Cond("value", "LT", 5)),
    ("pred_lte", "user_id <= 10", Cond("user_id", "LTE", 10)),
    ("pred_inside_mixed", "CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 1 END BETWEEN 6 AND 19", Cond("mix", "INSIDE", [5, 20]), docs_m),
    ("pred_outside_documents", "value < 2 OR value > 200", Cond("value", "OUTSIDE", [2, 200]), docs_e),
    ("pred_within_null", "event_type IN ('click','error')", Cond("event_type", "WITHIN", ["click", None]), docs_e),
    ("pred_without", "event_type NOT IN ('click','view')", Cond("event_type", "WITHOUT", ["click", "view"]), docs_e),
    ("pred_without_nonlist", "true", Cond("event_type", "WITHOUT", "click"), docs_e),
    ("pred_contains", "event_type = 'view'", Cond("tags", "CONTAINS", "view"), docs_a),
    ("pred_contains_num", "user_id = 7", Cond("tags", "CONTAINS", 7), docs_a),
    ("pred_contains_null", "true", Cond("tags", "CONTAINS", None), docs_a),
    ("pred_nested_path", "CAST(json_extract(props,'$.k') AS DOUBLE) > 50", Cond("props.k", "GT", 50), docs_e),
    ("pred_array_path", "event_type = 'signup'", Cond("tags[0]", "EQ", "signup"), docs_a),
    ("pred_unknown_op", "false", Cond("value", "LIKE", "x")),
    ("pred_filter_list", "event_type = 'click' AND value > 50", [Cond("event_type", "EQ", "click"), Cond("value", "GT", 50)]),
    ("pred_empty_or", "false", Or()),
    ("pred_and_or_not", "(event_type = 'click' OR value > 200) AND NOT (user_id > 75)", And(Or(Cond("event_type", "EQ", "click"), Cond("value", "GT", 200)), Not(Cond("user_id", "GT", 75)))),
    ("pred_and_or_not_documents", "(NULLIF(event_type,'error') = 'click' OR value > 200) AND NOT (user_id > 75)", And(Or(Cond("event_type", "EQ", "click"), Cond("value", "GT", 200)), Not(Cond("user_id", "GT", 75))), docs_e),
    ("pred_not_missing", "NULLIF(event_type,'error') IS NULL OR event_type <> 'click'", Not(Cond("event_type", "EQ", "click")), docs_e),
    ("pred_not_gt_missing", "CASE event_id % 4 WHEN 0 THEN user_id WHEN 1 THEN user_id WHEN 2 THEN 1 ELSE 0 END <= 50", Not(Cond("mix", "GT", 50)), docs_m),
]:
    _event_query(_name, _sql, _pred, *_table)


def _line_query(name: str, sql: str, pred) -> None:
    def run(spark, sf):
        return typed(spark, sf, "lineitem", "l_orderkey").scan(pred).select("l_orderkey", "l_linenumber")

    run.__name__ = name
    query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {sql}")(run)


_line_query("pred_inside", "l_quantity > 10 AND l_quantity < 12", Cond("l_quantity", "INSIDE", [10, 12]))
_line_query("pred_outside", "l_quantity < 2 OR l_quantity > 49", Cond("l_quantity", "OUTSIDE", [2, 49]))
_line_query("pred_between_halfopen", "l_quantity >= 10 AND l_quantity < 12", Cond("l_quantity", "BETWEEN", [10, 12]))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')")
def pred_within(spark, sf):
    return typed(spark, sf, "orders", "o_orderkey").scan(Cond("o_orderpriority", "WITHIN", ["1-URGENT", "2-HIGH"])).select("o_orderkey")


@query("SELECT o_orderkey FROM orders")
def pred_label(spark, sf):
    return typed(spark, sf, "orders", "o_orderkey").scan(Cond("_label", "EQ", "orders")).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) IN ('1','7','32')")
def pred_id(spark, sf):
    return typed(spark, sf, "orders", "o_orderkey").scan(Cond("_id", "WITHIN", ["1", "7", "32"])).select("o_orderkey")


@query("SELECT event_id AS id FROM events WHERE event_id IN (3, 11, 500)")
def pred_id_documents(spark, sf):
    return ids(docs_e(spark, sf).scan_ids(Cond("_id", "WITHIN", ["3", "11", "500"])))


# ---- keyed reads


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 = 0")
def get_many(spark, sf):
    t = typed(spark, sf, "customer", "c_custkey")
    want = t.rows.filter(F.col("c_custkey") % 5 == 0).select(F.col("c_custkey").alias("_id"))
    return t.get_many(want).filter(F.col("error").isNull()).select("c_custkey", "c_name")


@query("SELECT c_custkey + 5 AS wanted, CASE WHEN c_custkey + 5 <= (SELECT max(c_custkey) FROM customer) THEN 'found' ELSE 'missing' END AS outcome FROM customer WHERE c_custkey % 3 = 0")
def get_many_missing(spark, sf):
    t = typed(spark, sf, "customer", "c_custkey").documents()
    want = read(spark, sf, "customer").filter("c_custkey % 3 = 0").select((F.col("c_custkey") + 5).cast("string").alias("_id"))
    return t.get_many(want).select(F.col("_id").cast("long").alias("wanted"), F.when(F.col("error").isNull(), "found").otherwise("missing").alias("outcome"))


@query("SELECT c_name AS name FROM customer WHERE c_custkey = 42")
def get_one(spark, sf):
    return typed(spark, sf, "customer", "c_custkey").documents().get("42").select(F.variant_get("doc", "$.c_name", "string").alias("name"))


@query("SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS id FROM customer")
def list_keys(spark, sf):
    return typed(spark, sf, "customer", "c_custkey").keys().select(F.col("_id").alias("id"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE CAST(n_nationkey AS VARCHAR) >= '1' AND CAST(n_nationkey AS VARCHAR) < '2'")
def key_range(spark, sf):
    return typed(spark, sf, "nation", "n_nationkey").documents().key_range("1", "2").select(F.col("_id").alias("id"))


@query("SELECT c_custkey, c_name FROM customer WHERE starts_with(CAST(c_custkey AS VARCHAR), '12')")
def key_prefix(spark, sf):
    return typed(spark, sf, "customer", "c_custkey").key_range(prefix="12").select("c_custkey", "c_name")


@query("SELECT * FROM (VALUES (0, 3, 'found'), (1, -1, 'missing'), (2, 1, 'found'), (3, 3, 'found')) AS t(pos, wanted, outcome)")
def get_many_ordered(spark, sf):
    got = typed(spark, sf, "customer", "c_custkey").get_many([3, -1, 1, 3])
    outcome = F.when(F.col("error").isNull() & (F.col("c_custkey") == F.col("_wanted")), "found").otherwise("missing")
    return got.select(F.col("_pos").cast("int").alias("pos"), F.col("_wanted").cast("int").alias("wanted"), outcome.alias("outcome"))


# ---- writes


def store(spark: SparkSession) -> DocStore:
    return DocStore(spark, scratch_dir(spark, "store"))


def _orders(rows: DataFrame, origin: str, table: str = "v_orders") -> DataFrame:
    return rows.select(F.lit(table).alias("table_name"), F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.lit(origin).alias("origin"), "o_orderstatus")).alias("data"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM orders")
def bulk_load_insert_if_absent(spark, sf):
    s, orders = store(spark), read(spark, sf, "orders")
    s.bulk_load(_orders(orders.filter("o_orderkey % 2 = 0"), "old"))
    s.bulk_load(_orders(orders, "new"))
    return s.table("v_orders").scan().select(F.col("_id").cast("long").alias("o_orderkey"), F.variant_get("doc", "$.origin", "string").alias("origin"))


def _versions(spark, sf) -> DocTable:
    s, e = store(spark), read(spark, sf, "events")
    s.insert("v_user", e.select(F.col("user_id").alias("_id"), F.to_json(F.struct("event_id")).alias("doc"), F.col("event_id").alias("position")), order="position")
    return s.table("v_user")


@query("SELECT user_id, MAX(event_id) AS last_event FROM events GROUP BY user_id")
def bulk_load_latest(spark, sf):
    return _versions(spark, sf).versions("latest").select(F.col("_id").cast("long").alias("user_id"), F.variant_get("doc", "$.event_id", "long").alias("last_event"))


@query("SELECT user_id AS id, COUNT(*) AS versions FROM events GROUP BY user_id")
def bulk_load_all_versions(spark, sf):
    return _versions(spark, sf).scan().groupBy(F.col("_id").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("versions"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'malformed JSON' ELSE 'no id' END AS reason FROM orders WHERE o_orderkey % 7 = 0")
def bulk_load_rejects(spark, sf):
    s, orders = store(spark), read(spark, sf, "orders")
    rows = _orders(orders, "x").withColumn("data", F.when(F.col("id") % 7 == 0, F.lit('{"origin":')).otherwise(F.col("data")))
    return s.bulk_load(rows).rejected.select(F.col("id").cast("long").alias("id"), "reason")


def _after_delete(spark, sf) -> DocStore:
    s, orders = store(spark), read(spark, sf, "orders")
    s.bulk_load(_orders(orders, "x"))
    s.delete("v_orders", orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("_id")))
    return s


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def delete_rows(spark, sf):
    return _after_delete(spark, sf).table("v_orders").scan_ids().select(F.col("_id").cast("long").alias("o_orderkey"))


@query("SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE o_orderkey % 3 = 0) AS deleted FROM orders")
def compact_stats(spark, sf):
    return _after_delete(spark, sf).stats("v_orders").select("total", "deleted")


@query("SELECT COUNT(*) FILTER (WHERE o_orderkey % 3 <> 0) AS total, CAST(0 AS BIGINT) AS deleted FROM orders")
def compact_table(spark, sf):
    s = _after_delete(spark, sf)
    if not s.compact("v_orders"):
        raise AssertionError("a third of the rows is deleted")
    return s.stats("v_orders").select("total", "deleted")


@query("SELECT o_orderkey FROM orders WHERE NOT starts_with(CAST(o_orderkey AS VARCHAR), '1') AND CAST(o_orderkey AS VARCHAR) < '8'")
def delete_key_range(spark, sf):
    s = store(spark)
    s.bulk_load(_orders(read(spark, sf, "orders"), "x"))
    s.delete_range("v_orders", prefix="1")
    s.delete_range("v_orders", start="8")
    return s.table("v_orders").scan_ids().select(F.col("_id").cast("long").alias("o_orderkey"))


@query("SELECT count(*) AS total, true AS fits FROM orders")
def file_rotation(spark, sf):
    s = store(spark)
    s.bulk_load(_orders(read(spark, sf, "orders"), "x"), file_rows=500)
    files = s.table("v_orders").rows.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n"))
    return files.agg(F.sum("n").alias("total"), (F.max("n") <= 500).alias("fits"))


@query("SELECT 1 AS loads, count(*) AS n FROM orders")
def compact_by_loads(spark, sf):
    s, orders = store(spark), read(spark, sf, "orders")
    for k in range(3):
        s.insert("v_orders", orders.filter(F.col("o_orderkey") % 3 == k).select(F.col("o_orderkey").alias("_id"), F.lit("{}").alias("doc")))
    if not s.compact("v_orders", most_loads=2):
        raise AssertionError("there are three loads")
    return s.table("v_orders").scan_ids().agg(F.lit(s.load_count("v_orders")).alias("loads"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'e_' || event_type AS table_name, COUNT(*) AS n FROM events GROUP BY event_type")
def route_by_table(spark, sf):
    s, e = store(spark), read(spark, sf, "events")
    s.bulk_load(e.select(F.concat(F.lit("e_"), "event_type").alias("table_name"), F.col("event_id").alias("id"), F.to_json(F.struct("value")).alias("data")))
    out = None
    for name in s.tables():
        own = s.table(name).scan_ids().select(F.lit(name).alias("table_name"), "_id")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


# ---- indexes


def _event_store(spark, sf) -> DocStore:
    s, t = store(spark), docs_e(spark, sf)
    s.insert("e_Event", t.scan())
    s.add_index("e_Event", "event_type")
    return s


def _row_id(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").cast("long").alias("row_id"))


@query("SELECT NULLIF(event_type,'error') AS value, event_id AS row_id FROM events")
def index_backfill(spark, sf):
    rows = _event_store(spark, sf).index_rows("e_Event", "event_type")
    return rows.select(F.col("value").cast("string").alias("value"), F.col("row_id").cast("long").alias("row_id"))


@query("SELECT event_id AS row_id FROM events WHERE event_type = 'purchase'")
def index_lookup_label(spark, sf):
    return _row_id(_event_store(spark, sf).ids_by_label_field("e_Event", "event_type", "purchase"))


@query("SELECT event_id AS row_id FROM events WHERE event_type IN ('error', 'view')")
def index_lookup_stored(spark, sf):
    s = _event_store(spark, sf)
    s.store_index("e_Event", "event_type")
    return _row_id(s.ids_by_label_field("e_Event", "event_type", ["view", None], "WITHIN"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS row_id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_nationkey = 3")
def index_lookup_any_label(spark, sf):
    s = store(spark)
    for name, key, nation in (("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey")):
        s.insert(f"v_{name}", read(spark, sf, name).select(F.col(key).alias("_id"), F.to_json(F.struct(F.col(nation).alias("nation"))).alias("doc")))
        s.add_index(f"v_{name}", "nation")
    return s.ids_by_field("nation", 3)


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000")
def index_fetch_join(spark, sf):
    s = store(spark)
    s.insert("v_Customer", typed(spark, sf, "customer", "c_custkey").documents().scan())
    s.add_index("v_Customer", "c_acctbal")
    got = s.table("v_Customer").fetch(s.ids_by_label_field("v_Customer", "c_acctbal", 5000, "GT"))
    return got.select(F.col("_id").cast("long").alias("c_custkey"), F.variant_get("doc", "$.c_name", "string").alias("c_name"))


@query("SELECT event_id AS row_id FROM events WHERE event_id <> 17")
def index_delete_row_field(spark, sf):
    s = _event_store(spark, sf)
    s.delete_row_field("e_Event", "event_type", "17")
    return _row_id(s.index_rows("e_Event", "event_type"))


@query("SELECT event_id AS row_id FROM events WHERE event_id <> 17 AND value > 100")
def index_stored_kept_up(spark, sf):
    """An index stored before most rows are loaded, with a row taken out before it is stored."""
    s, t = store(spark), docs_e(spark, sf)
    s.insert("e_Event", t.scan(Cond("user_id", "LT", 50)))
    s.insert("e_Event", t.scan(Cond("_id", "EQ", "17")).join(s.table("e_Event").scan_ids(), "_id", "left_anti"))
    s.add_index("e_Event", "value")
    s.delete_row_field("e_Event", "value", "17")
    s.store_index("e_Event", "value")
    s.bulk_load(t.scan().select(F.lit("e_Event").alias("table_name"), F.col("_id").alias("id"), F.col("doc").alias("data")))
    return _row_id(s.ids_by_label_field("e_Event", "value", 100, "GT"))


@query("SELECT 'customer' AS label, 'c_name' AS field, true AS refused")
def index_duplicate(spark, sf):
    s, refused = _catalogued(spark, sf), False
    s.add_index("v_customer", "c_name")
    try:
        s.add_index("v_customer", "c_name")
    except IndexExists:
        refused = True
    return s.indexes().withColumn("refused", F.lit(refused))


@query("SELECT * FROM (VALUES ('customer','c_name'),('e_region','r_name')) AS t(label, field)")
def index_reload(spark, sf):
    s = _catalogued(spark, sf)
    s.add_index("v_customer", "c_name")
    s.add_index("e_region", "r_name")
    return DocStore.open(spark, s.files.root).indexes()


@query("SELECT * FROM (VALUES ('Customer','c_nationkey'),('e_Order','o_orderstatus')) AS t(label, field)")
def list_fields(spark, sf):
    s = store(spark)
    s.add_index("v_Customer", "c_nationkey")
    s.add_index("e_Order", "o_orderstatus")
    s.add_index("v_Customer", "c_name")
    s.remove_index("v_Customer", "c_name")
    return s.indexes()


# ---- catalog


def _catalogued(spark, sf) -> DocStore:
    s = store(spark)
    for name, table in (("v_customer", "customer"), ("v_supplier", "supplier"), ("e_region", "region")):
        s.create_table(name, read(spark, sf, table).columns)
    return s


@query("SELECT * FROM (VALUES ('customer'),('supplier')) AS t(label)")
def list_labels(spark, sf):
    return _catalogued(spark, sf).labels()


@query("SELECT * FROM (VALUES ('e_region')) AS t(label)")
def list_edge_labels(spark, sf):
    return _catalogued(spark, sf).labels(edges=True, strip=False)


@query("SELECT * FROM (VALUES ('e_region'),('v_customer'),('v_supplier')) AS t(name)")
def list_tables(spark, sf):
    return _catalogued(spark, sf).tables_df().select("name")


@query("SELECT * FROM (VALUES ('v_customer'),('v_supplier')) AS t(name)")
def drop_table(spark, sf):
    s = _catalogued(spark, sf)
    s.drop("e_region")
    return s.tables_df().select("name")


@query("SELECT DISTINCT column_name FROM (DESCRIBE region)")
def all_col_names(spark, sf):
    s = store(spark)
    for name in ("v_region", "e_region"):
        s.create_table(name, read(spark, sf, "region").columns)
    return s.column_names()


@query("SELECT 'v_customer' AS name, column_name FROM (DESCRIBE customer) UNION ALL SELECT 'v_supplier', column_name FROM (DESCRIBE supplier) UNION ALL SELECT 'e_region', column_name FROM (DESCRIBE region)")
def reopened_tables(spark, sf):
    s = DocStore.open(spark, _catalogued(spark, sf).files.root)
    return s.tables_df().select("name", F.explode("columns").alias("column_name"))


@query("SELECT column_name FROM (DESCRIBE supplier)")
def column_defs(spark, sf):
    s = _catalogued(spark, sf)
    return spark.createDataFrame([(c,) for c in s.table("v_supplier").column_defs()], "column_name string")


@query("SELECT CAST(3 AS BIGINT) AS tables, CAST(3 AS BIGINT) AS ids, true AS kept")
def table_ids(spark, sf):
    s = _catalogued(spark, sf)
    before = s.tables_df().select("name", F.col("uuid").alias("before")).collect()
    s.create_table("v_customer")
    both = s.tables_df().join(spark.createDataFrame(before, "name string, before string"), "name")
    return both.agg(F.count("name").alias("tables"), F.count_distinct("uuid").alias("ids"), F.bool_and(F.col("uuid") == F.col("before")).alias("kept"))


@query("SELECT count(*) AS n FROM region")
def used_after_close(spark, sf):
    s = store(spark)
    s.insert("v_region", typed(spark, sf, "region", "r_regionkey").documents().scan())
    s.close()
    return DocStore.open(spark, s.files.root).table("v_region").scan().agg(F.count(F.lit(1)).alias("n"))


def _printed(spark, args) -> list[str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        if cli.main(args, spark):
            raise AssertionError(args)
    return out.getvalue().splitlines()


def _nations(spark, sf) -> DocStore:
    s = _catalogued(spark, sf)
    s.insert("v_nation", typed(spark, sf, "nation", "n_nationkey").documents().scan())
    return s


@query("SELECT * FROM (VALUES ('e_region'),('v_customer'),('v_supplier')) AS t(line)")
def cli_tables(spark, sf):
    return spark.createDataFrame([(x,) for x in _printed(spark, ["tables", _catalogued(spark, sf).files.root])], "line string")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS line FROM nation")
def cli_keys(spark, sf):
    return spark.createDataFrame([(x,) for x in _printed(spark, ["keys", _nations(spark, sf).files.root, "v_nation"])], "line string")


@query("SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey IN (3, 7)")
def cli_get(spark, sf):
    lines = _printed(spark, ["get", _nations(spark, sf).files.root, "v_nation", "7", "x", "3"])
    return spark.createDataFrame([(x,) for x in lines], "line string").select(F.get_json_object("line", "$.n_nationkey").cast("int").alias("key"), F.get_json_object("line", "$.n_name").alias("name"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_nationkey AS inner_id, n_name AS name FROM nation")
def print_json_lines(spark, sf):
    lines = _nations(spark, sf).table("v_nation").scan_json().select("_id", "json")
    return lines.select(F.get_json_object("json", "$._id").alias("id"), F.get_json_object("json", "$.n_nationkey").cast("int").alias("inner_id"), F.get_json_object("json", "$.n_name").alias("name"))


@query("SELECT c_custkey AS id FROM customer")
def ids_for_label(spark, sf):
    s = store(spark)
    s.insert("v_Customer", typed(spark, sf, "customer", "c_custkey").documents().scan())
    return ids(s.ids_for_label("v_Customer").unionByName(s.ids_for_label("v_Nothing")))


# ---- functions and sources


@query(
    """SELECT CAST(h % 4 AS INTEGER) AS "partition", count(*) AS n FROM (
  SELECT list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(CAST(c_custkey AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                     lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM customer) GROUP BY 1"""
)
def partition_histogram(spark, sf):
    rows = read(spark, sf, "customer").select(partition_of(F.col("c_custkey").cast("string")).alias("partition"))
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 6 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR),6,'0') END AS padded FROM customer")
def pad_six_query(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", pad_six(F.col("c_custkey").cast("string")).alias("padded"))


QUERIES["pad_six"], ORACLE_SQL["pad_six"] = QUERIES.pop("pad_six_query"), ORACLE_SQL.pop("pad_six_query")


@query("SELECT 'v_' || n_name AS name, 'v_' AS kind, n_name AS label FROM nation")
def table_labels(spark, sf):
    n = read(spark, sf, "nation").select(F.concat(F.lit("v_"), "n_name").alias("name"))
    return n.select("name", kind_of_table(F.col("name")).alias("kind"), label_of_table(F.col("name")).alias("label"))


@query("SELECT 'F' || chr(31) || 'name' || chr(31) || 'v_nation' || chr(31) || '\"' || n_name || '\"' || chr(31) || n_nationkey AS key, 'R' || chr(31) || 'v_nation' || chr(31) || 'name' || chr(31) || n_nationkey AS reverse_key, CAST(n_nationkey AS VARCHAR) AS row_id FROM nation")
def index_keys(spark, sf):
    row, value = F.col("n_nationkey").cast("string"), F.concat(F.lit('"'), "n_name", F.lit('"'))
    rows = read(spark, sf, "nation").select(field_key(F.lit("name"), F.lit("v_nation"), value, row).alias("key"), reverse_key(F.lit("v_nation"), F.lit("name"), row).alias("reverse_key"))
    return rows.select("key", "reverse_key", field_key_parts(F.col("key"))["row_id"].alias("row_id"))


@query(
    """SELECT n_name, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)),
                             lambda a, b: (xor(a, b) * 16777619) % 4294967296) AS h FROM nation"""
)
def hash_fnv1a(spark, sf):
    return read(spark, sf, "nation").select("n_name", fnv1a(F.col("n_name")).alias("h"))


@query("SELECT * FROM (VALUES ('a.b','$_current.a.b','$.a.b','_current'),('$g.a','$g.a','$.a','g'),('$.a','$_current.a','$.a','_current'),('a','$_current.a','$.a','_current')) AS t(path, normal, local, namespace)")
def path_forms(spark, sf):
    paths = ["a.b", "$g.a", "$.a", "a"]
    return spark.createDataFrame([(p, normalize_path(p), local_path(p), namespace_of(p)) for p in paths], "path string, normal string, local string, namespace string")


@query("SELECT * FROM (VALUES ('event_type'),('value'),('user_id')) AS t(field)")
def required_fields_query(spark, sf):
    pred = And(Or(Cond("event_type", "EQ", "click"), Cond("value", "GT", 200)), Not(Cond("user_id", "GT", 75)), Cond("value", "LT", 1000))
    return spark.createDataFrame([(f,) for f in required_fields(pred)], "field string")


QUERIES["required_fields"], ORACLE_SQL["required_fields"] = QUERIES.pop("required_fields_query"), ORACLE_SQL.pop("required_fields_query")


@query("SELECT event_id AS id FROM events WHERE value > 100 AND user_id % 2 = 1")
def row_filter(spark, sf):
    """A filter of the user's own among the conditions: a column over the table's columns."""
    return ids(typed(spark, sf, "events", "event_id").scan_ids(And(Cond("value", "GT", 100), F.col("user_id") % 2 == 1)))


@query(
    """SELECT n_nationkey, hex(encode('Tv_' || n_name)) AS table_key,
       '50' || printf('%02X%02X', n_nationkey % 256, n_nationkey // 256) || hex(encode(n_name)) AS position_key,
       printf('%02X%02X%02X%02X', n_nationkey % 256, n_nationkey // 256, 1, 0) || printf('%02X%02X0000', n_nationkey * 100 % 256, n_nationkey * 100 // 256) || 'EC070000' AS location FROM nation"""
)
def key_codecs(spark, sf):
    n = F.col("n_nationkey")
    row = (n, F.hex(table_key(F.concat(F.lit("v_"), "n_name"))).alias("table_key"), F.hex(position_key(n, F.col("n_name"))).alias("position_key"))
    return read(spark, sf, "nation").select(*row, F.hex(location(n, F.lit(1), n * 100, F.lit(2028))).alias("location"))


@query("SELECT n_nationkey, CAST(8 AS INTEGER) AS n, true AS alphanumeric FROM nation")
def random_names(spark, sf):
    names = read(spark, sf, "nation").select("n_nationkey", F.randstr(F.lit(8)).alias("name"))
    return names.select("n_nationkey", F.char_length("name").alias("n"), F.col("name").rlike("^[A-Za-z0-9]+$").alias("alphanumeric"))


@query("SELECT 'key_' || i AS id, substr(sha256('7-' || i || '-0') || sha256('7-' || i || '-1'), 1, 100) AS data FROM range(50) AS t(i)")
def generated_documents(spark, sf):
    s = store(spark)
    s.bulk_load(random_documents(spark, "v_scale", 50, 100, seed=7))
    return s.table("v_scale").scan().select(F.col("_id").alias("id"), F.variant_get("doc", "$.data", "string").alias("data"))


@query("SELECT CAST(40 AS BIGINT) AS n, CAST(40 AS BIGINT) AS different, true AS inside")
def generated_integers(spark, sf):
    got = distinct_integers(spark, 40, 1000, seed=3)
    return got.agg(F.count("value").alias("n"), F.count_distinct("value").alias("different"), F.bool_and(F.col("value").between(0, 999)).alias("inside"))


@query("SELECT true AS there, false AS folder, true AS copied, CAST(9 AS BIGINT) AS bytes")
def file_helpers(spark, sf):
    files = Files(spark, scratch_dir(spark, "files"))
    files.make(files.at())
    files.write_new(files.at("a"), "some text")
    n = files.copy(files.at("a"), files.at("b"))
    return spark.createDataFrame([(files.exists(files.at("a")), files.is_dir(files.at("a")), files.read(files.at("b")) == "some text", n)], "there boolean, folder boolean, copied boolean, bytes long")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def json_lines_source(spark, sf):
    path = scratch_dir(spark, "lines")
    read(spark, sf, "customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("_id"), "c_name")).alias("value")).write.option("compression", "gzip").text(path)
    s = store(spark)
    s.bulk_load(read_documents(spark, path, "v_customer"))
    return s.table("v_customer").scan().select(F.col("_id").alias("id"), F.variant_get("doc", "$.c_name", "string").alias("name"))


@query("SELECT count(*) AS n FROM orders")
def line_count(spark, sf):
    path = scratch_dir(spark, "lines")
    read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value")).write.text(path)
    return read_lines(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer")
def stream_ingest(spark, sf):
    from .streaming import stream_lines_into

    path = scratch_dir(spark, "stream")
    lines = read(spark, sf, "customer").select(F.to_json(F.struct(F.col("c_custkey").cast("string").alias("_id"), "c_name")).alias("value"))
    lines.write.text(f"{path}/in")
    s = store(spark)
    stream_lines_into(s, f"{path}/in", "v_customer", f"{path}/progress").awaitTermination()
    return s.table("v_customer").scan_ids().select(F.col("_id").alias("id"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and clicks whose k is over 50."""
    return docs_e(spark, sf).scan_ids(And(Cond("event_type", "WITHIN", ["purchase", "click"]), Cond("props.k", "GT", 50)))
