import pandas as pd
import pytest

import __spark_entry__ as entry
from docloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    df = df[sorted(df.columns)]
    out = []
    for row in df.itertuples(index=False, name=None):
        out.append(tuple(None if v is None or (isinstance(v, float) and v != v) or v is pd.NaT else round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v for v in row))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    want = duck.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark, sf):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
