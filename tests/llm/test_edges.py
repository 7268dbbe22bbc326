"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from collections import Counter
from types import SimpleNamespace

import pytest
from llm_fixtures import CLASHING, crc
from pyspark.sql import functions as F

from docloom.functions.scratch import scratch_dir
from docloom.llm import common, decontamination, exact_dedup, language, quality, sentencepiece_fst, sharding, simhash_dedup, token_count, toxicity, url_filter
from docloom.llm.common import tokenizer_path

PIECES, BPE = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def per_document(labels):
    return {
        "sharding": lambda d: sharding.shard_documents(d, 24),
        "quality": lambda d: quality.quality_scores(d, labels),
        "simhash": simhash_dedup.near_report,
        "toxicity": lambda d: toxicity.toxicity_scores(d, labels),
        "language": language.languages,
        "sentencepiece": lambda d: sentencepiece_fst.encode_documents(d, PIECES),
        "exact": exact_dedup.dedup_report,
        "tokens": lambda d: token_count.token_counts(d, BPE),
    }


NAMES = ["sharding", "quality", "simhash", "toxicity", "language", "sentencepiece", "exact", "tokens"]


@pytest.mark.parametrize("name", NAMES)
def test_a_row_for_each_document(spark, hostile, nothing, labels, name):
    run = per_document(labels)[name]
    ids = lambda df: Counter(r[0] for r in df.select("doc_id").collect())
    plain = run(hostile)
    assert ids(plain) == ids(hostile)
    wide = hostile
    for c in CLASHING:
        wide = wide.withColumn(c, F.lit("clash"))
    again = run(wide)
    assert again.columns == plain.columns
    order = lambda rows: sorted(map(repr, rows))
    drop = [] if name != "sharding" else ["slot"]  # slots of repeated rows are exchangeable
    assert order(again.drop(*drop).collect()) == order(plain.drop(*drop).collect())
    assert run(nothing).collect() == [] and run(nothing).columns == plain.columns


def test_stages_keep_the_columns(spark, hostile, nothing, labels):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "three word item"), (None, "another text for the same id")], "item_id bigint, text string")
    wide = hostile
    for c in CLASHING:
        wide = wide.withColumn(c, F.lit("clash"))
    for stage in (lambda d: toxicity.drop_toxic(d, labels), exact_dedup.drop_copies, simhash_dedup.drop_near, lambda d: decontamination.drop_leaks(d, bench)):
        got = stage(wide)
        assert got.columns == wide.columns and 0 < got.count() <= wide.count()
        assert stage(nothing).collect() == [] and stage(nothing).columns == nothing.columns
    left = decontamination.drop_leaks(hostile, bench)
    assert left.filter("text = 'another text for the same id'").count() == 0 and left.count() == hostile.count() - 1
    assert left.filter("doc_id = 6").count() == 1  # the other document of that id stays


def test_scores_lie_between_0_and_1_and_folds_hold(hostile, labels):
    for got, mod, rest in ((quality.quality_scores(hostile, labels), 5, 0), (toxicity.toxicity_scores(hostile, labels), 4, 2)):
        for r in got.collect():
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (crc(r["doc_id"]) % mod == rest)
    for r in language.languages(hostile).collect():
        assert 0 <= r["score"] <= 1 and r["held_out"] == (crc(r["doc_id"]) % 3 == 1)


def test_without_labels(spark, hostile):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity_scores(hostile, none).filter("predicted = 1").count() == 0
    assert quality.quality_scores(hostile, none).count() == hostile.count()
    assert {r[0] for r in language.languages(hostile.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").collect()} == {"und"}


def test_urls(spark):
    urls = [None, "", "nourl", "://", "http://", "HTTP://A.B.Net/x?y#z", "http://net", "http://net/", "https://x.example.net/en/1", "https://example.net/enx", "ftp://a.org/fr/", "http://aorg/fr/",
            "http://shop.example.org/en/5?u=1&ref=x#y", "https://www.shop.example.org/en/5.html#t", "http://shop.example.org/fr/1?ref=x", "a\n://Ü.COM:80/p\nq"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(13, urls[13]), (None, urls[12])], "page_id bigint, url string").withColumn("canon", F.lit("x")).withColumn("k", F.lit(1)).withColumn("hit", F.lit(0))
    got = {r["page_id"]: r for r in url_filter.judge_pages(pages).collect()}
    assert url_filter.judge_pages(pages).count() == len(urls) + 2
    row = lambda i: (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"])
    assert [row(i) for i in range(5)] == [("", "", None, "allow")] * 5
    assert row(5) == ("a.b.net", "/x", "net/", "block") and row(6) == ("net", "", None, "allow") and row(7) == ("net", "/", "net/", "block")
    assert row(8)[2:] == ("example.net/en/", "allow") and row(9)[2:] == ("net/", "block") and row(10)[2:] == ("org/fr/", "allow") and row(11)[2] is None
    assert row(12)[2:] == (None, "block") and row(13)[2:] == (None, "block") and row(14)[2:] == ("org/fr/", "allow")
    assert row(15) == ("Ü.com:80", "/p\nq", None, "allow") and got[None]["verdict"] == "block"
    assert url_filter.judge_pages(pages.limit(0)).collect() == []
    other = {r["page_id"]: r["verdict"] for r in url_filter.judge_pages(spark.createDataFrame([(1, "http://a.com/x?xref=1"), (2, "http://a.com/y#?ref=1"), (3, "http://a.com/z?ref=1"), (4, "http://m.a.com/z.html/"), (5, "ref=1?ref=2")], "page_id bigint, url string")).collect()}
    assert other == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_a_hot_url_stays_where_it_is(spark):
    """A third of the pages share one url that is listed: they meet its verdict in a broadcast table, not in one task."""
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, "http://hot.com/a?ref=1").otherwise(F.concat(F.lit("http://h.com/"), "id")).alias("url"))
    got = url_filter.judge_pages(pages)
    assert got.filter("verdict = 'block'").count() == 2000 and got.count() == 6000
    assert got.filter("verdict = 'block' AND host <> 'hot.com'").count() == 0
    names = {r["canon"]: r["n"] for r in url_filter.listed_among(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "canon string"), "canon", spark.createDataFrame([("a",)], "k string"), "k").collect()}
    assert names == {"a": 2}


def test_rows_without_an_id_spread_over_slot_buckets(spark):
    """A third of the rows have no id, so one shard; their slots are numbered in many buckets, and any hash gives u below 1."""
    docs = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    got = sharding.shard_documents(docs, 24).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 6000
    shard = {r["shard"] for r in got if r["doc_id"] is None}
    assert len(shard) == 1 and len({r["grown_shard"] for r in got if r["doc_id"] is None}) == 1
    names = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    spread = spark.createDataFrame([tuple(r[c] for c in names) for r in got if r["doc_id"] is None], "doc_id bigint, size bigint, text_crc32 bigint, shard int, grown_shard int")
    assert spread.select(F.pmod(F.xxhash64(*names), F.lit(sharding.SLOT_BUCKETS)).alias("b")).distinct().count() > 500
    assert (2**52 - 1 + 0.5) * 2.0**-52 < 1


@pytest.mark.parametrize("of", [common.shared_dir, lambda s: scratch_dir(s, "x")])
def test_no_folder_of_one_machine_on_a_cluster(of):
    session = lambda master, at=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: at), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None))
    for master in ("spark://a:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError, match="checkpoint"):
            of(session(master))
        assert of(session(master, "/shared")).startswith("/shared")
    assert of(session("local[4]"))
