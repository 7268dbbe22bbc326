"""The pipeline against the stages done by hand on a small table."""

import random
from collections import Counter

from llm_fixtures import CLASHING, SCHEMA, prose
from pyspark.sql import functions as F
from test_operators import brute_leaks
from test_similar import brute_kept

import __spark_entry__ as entry
import corpus_pipeline
from docloom.llm import toxicity


def tables(spark, tmp_path):
    rnd = random.Random(31)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 7 == 0
        w = prose(rnd, 60).split()
        if toxic:
            w[10], w[20] = "vermin", "scumbag"
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    items = [(i, prose(rnd, 25)) for i in range(8)]
    clean = [r for r in rows if r[0] % 7]
    rows += [(1000 + i, clean[i][1], "fr", "t", 2) for i in range(20)]
    rows += [(2000 + i, clean[30 + i][1] + " end", "fr", "t", 2) for i in range(20)]
    rows += [(3000 + i, prose(rnd, 30) + " " + items[i % 8][1], "fr", "t", 2) for i in range(20)]
    rows += [(4000, None, None, None, None), (4001, "", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, labels, items


def test_pipeline_by_hand(spark, tmp_path):
    rows, labels, items = tables(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("predicted = 1").collect()}
    assert {i for i, _, t in labels if t} <= toxic and len(toxic) < 80
    left = [(i, t) for i, t, *_ in rows if i not in toxic]
    last = {}
    for i, t in left:
        last[t or ""] = max(last.get(t or "", i), i)
    left = [(i, t) for i, t in left if last[t or ""] == i]
    one_each = brute_kept(left)
    assert len(one_each) < len(left)
    left = [(i, t) for i, t in left if i in one_each]
    leaking = {i for i, _ in brute_leaks(left, items)}
    assert len(leaking) >= 18
    left = [(i, t) for i, t in left if i not in leaking]
    got = corpus_pipeline.run(spark, sf)
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(i for i, _ in left)
    assert got.filter("NOT round_trip").count() == 0 and got.filter("n_tokens <> size(token_ids)").count() == 0


def test_stages(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near dedup", "benchmark decontamination", "sentencepiece"]
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and entry.queries()["pipeline"] is corpus_pipeline.run


def test_pipeline_over_hostile_rows(spark, hostile, labels, tmp_path):
    """Nulls, repeats, empty and very long texts and clashing columns through all stages; and no rows at all."""
    wide = hostile
    for c in CLASHING:
        wide = wide.withColumn(c, F.lit("clash"))
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "three word item"), (None, "another text for the same id")], "item_id bigint, text string")
    for name, docs in (("wide", wide), ("nothing", wide.limit(0))):
        at = f"{tmp_path}/{name}"
        docs.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        bench.write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        if name == "nothing":
            assert got == []
            continue
        toxic = {(r["doc_id"], r["text"]) for r in wide.select("doc_id", "text").collect()} - {(r["doc_id"], r["text"]) for r in toxicity.drop_toxic(wide, labels).select("doc_id", "text").collect()}
        left = {}
        for i, t in {(r["doc_id"], r["text"]) for r in wide.select("doc_id", "text").collect()} - toxic:
            left[t or ""] = max((x for x in (left.get(t or ""), i) if x is not None), default=None)
        rows = [(i, t) for t, i in left.items() if t != "another text for the same id"]
        assert all(i is not None for i, _ in rows)
        assert Counter(r["doc_id"] for r in got) == Counter(brute_kept(rows))
