import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.plans import And, Cond, Not, Or, TypedResolver, VariantResolver, compile_pair, compile_predicate
from docloom.plans.predicates import is_noop, required_fields
from oracle import evaluate, holds

VALUES = [None, "x", "y", "2", " 2", "1e400", "NaN", "", "1", "0x1p4", "inf", "-Infinity", "1d", 1, 2, 1.0, 0.5, -3, True, False,
          ["x"], [1, "x"], [None], [], {"k": 1}, {"a": 1, "k": [1, 2.5]}, 2**53]
CONSTANTS = [None, "x", "2", "0x1p4", "abc", 1, 1.5, True, ["x"], [None], [1, 2], ["1", 2], [1, "x"], [], {"k": 1}, ["x", None, 1, True], [[1, "x"], {"k": 1}], [0, "inf"]]
OPS = ["EQ", "NEQ", "GT", "GTE", "LT", "LTE", "INSIDE", "OUTSIDE", "BETWEEN", "WITHIN", "WITHOUT", "CONTAINS", "LIKE"]


def check(df, conds, resolver, values):
    """Each condition and its complement, by one pass over df(i, ...), against the oracle."""
    cols = []
    for k, c in enumerate(conds):
        t, f = compile_pair(c, resolver)
        cols += [F.coalesce(t, F.lit(False)).alias(f"t{k}"), F.coalesce(f, F.lit(False)).alias(f"f{k}")]
    for row in df.select("i", *cols).collect():
        for k, c in enumerate(conds):
            want = holds(values[row["i"]], c.op, c.value)
            assert (row[f"t{k}"], row[f"f{k}"]) == (want, not want), (values[row["i"]], c)


@pytest.mark.parametrize("op", OPS)
def test_truth_table_of_documents(spark, op):
    docs = [(i, json.dumps({"f": v})) for i, v in enumerate(VALUES)] + [(len(VALUES), "{}"), (len(VALUES) + 1, "null")]
    df = spark.createDataFrame(docs, "i int, j string").select("i", F.parse_json("j").alias("doc"))
    check(df, [Cond("f", op, c) for c in CONSTANTS], VariantResolver(), [*VALUES, None, None])


@pytest.mark.parametrize(
    "kind,values",
    [
        ("string", [None, "x", "2", " 2", "1e400", "NaN", "", "1", "0x1p4", "-inf"]),
        ("double", [None, 1.0, 2.0, 0.5, -3.0, float("nan"), float("inf")]),
        ("int", [None, 1, 2, -3, 2**31 - 1]),
        ("bigint", [None, 1, 2, 2**53 + 1, -(2**63)]),
        ("boolean", [None, True, False]),
        ("array<string>", [None, ["x"], ["x", "y"], [None], []]),
        ("array<double>", [None, [1.0, 2.0], [0.5], []]),
        ("decimal(10,2)", [None, 1.0, 2.5]),
    ],
)
def test_truth_table_of_columns(spark, kind, values):
    from decimal import Decimal

    given = [Decimal(str(v)) if kind.startswith("decimal") and v is not None else v for v in values]
    df = spark.createDataFrame(list(enumerate(given)), f"i int, f {kind}")
    conds = [Cond("f", op, c) for op in OPS for c in [*CONSTANTS, 2, 2.5, 1e30, -1e30, ["x", "y"], [1.0, 2.0], 2**53 + 1] if not (kind == "bigint" and isinstance(c, float) and abs(c) == 1e30 and op == "X")]
    check(df, conds, TypedResolver(df.schema), values)


def test_random_trees(spark):
    rnd = random.Random(5)
    docs = [{k: rnd.choice(VALUES) for k in "abc" if rnd.random() < 0.8} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("doc"))

    def tree(depth):
        if depth == 0 or rnd.random() < 0.3:
            return Cond(rnd.choice("abcz"), rnd.choice(OPS), rnd.choice(CONSTANTS))
        k = rnd.choice([Not, And, Or])
        return Not(tree(depth - 1)) if k is Not else k(*(tree(depth - 1) for _ in range(rnd.randrange(3))))

    trees = [tree(3) for _ in range(25)]
    got = df.select("i", *[F.coalesce(compile_predicate(p, VariantResolver()), F.lit(False)).alias(f"p{k}") for k, p in enumerate(trees)]).collect()
    for row in got:
        for k, p in enumerate(trees):
            assert row[f"p{k}"] == evaluate(docs[row["i"]], p)


def test_filters_reach_the_scan(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    pred = And(Cond("user_id", "WITHIN", [1, 2]), Cond("value", "LTE", 5), Not(Cond("event_type", "EQ", "click")))
    plan = events.filter(compile_predicate(pred, TypedResolver(events.schema))).select("event_id")._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "In(user_id, [1,2])" in pushed and "LessThanOrEqual(value,5.0)" in pushed and "event_type" in pushed


def test_pseudo_fields_bad_paths_and_hooks(spark):
    df = spark.createDataFrame([("1", '{"a":{"b":[1,{"c":"x"}]},"$":{"a":5}}')], "_id string, j string").select("_id", F.parse_json("j").alias("doc"))
    r = VariantResolver(label="Person")
    for pred, n in [
        (Cond("_id", "EQ", "1"), 1), (Cond("_label", "EQ", "Person"), 1), (Cond("a.b[1].c", "EQ", "x"), 1), (Cond("./a", "NEQ", None), 1), (Cond("a..b", "CONTAINS", 1), 1),
        (Cond("$.a", "EQ", 5), 1), (Cond("a.b[-1]", "EQ", None), 1), (And(), 1), (Or(), 0), ([], 1), (None, 1),
    ]:
        assert df.filter(compile_predicate(pred, r)).count() == n, pred
    for bad in ("a[", "a[]", "a[x]"):
        with pytest.warns(UserWarning):
            assert df.filter(compile_predicate(Cond(bad, "EQ", None), r)).count() == 0
    assert is_noop(None) and is_noop([]) and not is_noop(Or())
    assert required_fields(And(Cond("a", "EQ", 1), Not(Or(Cond("b", "EQ", 1), Cond("a", "LT", 2))))) == ["a", "b"]
