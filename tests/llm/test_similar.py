"""The near-dedup stage's rule, five-word shingles of similarity 0.8 or more, against brute force."""

import random
import re

import numpy as np
from llm_fixtures import SCHEMA, prose
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import similar, simhash_dedup


def brute_sets(texts):
    words = [re.findall(r"[^ \t\n\v\f\r]+", (t or "").lower()) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]


def brute_kept(rows):
    sets, at = brute_sets([r[1] for r in rows]), list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 9 * both >= 4 * (len(sets[i]) + len(sets[j])):  # both / (a + b - both) >= 0.8
                at[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return {r[0] for i, r in enumerate(rows) if least[top(i)] == r[0]}


def edited(rnd, text, k):
    w = text.split()
    for _ in range(k):
        i = rnd.randrange(len(w))
        w[i : i + rnd.randrange(2)] = [prose(rnd, 1)]
    return " ".join(w)


def cases():
    rnd = random.Random(5)
    base = [prose(rnd, rnd.choice([3, 5, 9, 30, 60, 200])) for _ in range(120)]
    licence = prose(rnd, 40)
    base += [licence + " " + prose(rnd, rnd.choice([2, 8, 15, 60])) for _ in range(60)]
    texts = base + [edited(rnd, t, rnd.choice([1, 1, 2, 3, 6])) for t in base] + [t + " end" for t in base[:40]] + [t.upper() for t in base[:10]]
    a = prose(rnd, 13).split()  # nine shingles; exactly 0.8 with one more at either end, 8 / 10
    texts += [" ".join(a), " ".join(a[1:] + ["tail"]), None, "", " \n"]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


def test_near_stage_links_all_of_similarity_08(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, SCHEMA)
    expected = brute_kept(rows)
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert {r["doc_id"] for r in got.collect()} == expected
    assert len(rows) - 5 in expected and len(rows) - 4 not in expected  # a pair at exactly 0.8
    assert 100 < len(rows) - len(expected) < len(rows) - 100


def test_op3_keeps_its_own_rule(spark):
    rows = cases()
    got = {r["doc_id"]: r["fingerprint"] for r in simhash_dedup.near_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(int(got[i], 16) == simhash_dedup.fingerprint(t, 3) for i, t, *_ in rows)


def test_crowded_buckets_and_a_large_group(spark, monkeypatch):
    """A bucket that is cut into parts loses no pair, and a group of near copies isn't compared pair by pair."""
    rnd = random.Random(8)
    base, star = prose(rnd, 300), prose(rnd, 90)
    rows = [(i, edited(rnd, base, 1), "en", "s", 1) for i in range(100)] + [(100 + i, edited(rnd, star, i > 0), "en", "s", 1) for i in range(60)] + [(200 + i, prose(rnd, 40), "en", "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    own = similar.prefixes(docs).cache()
    nodes = own.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("sim", "size", "least", "prefix")]).cache()
    whole = similar.similar
    for most in (20_000, 25):
        monkeypatch.setattr(similar, "similar", lambda *args, block=64 if most > 100 else 7: whole(*args, block=block))  # one part, and several
        edges = similar.links(docs, own.select("doc_id", "t", "fp"), nodes, bucket_rows=most).collect()
        fp = {r["doc_id"]: r["fp"] for r in own.select("doc_id", "fp").collect()}
        at = {x: x for x in fp.values()}

        def top(x, at=at):
            while at[x] != x:
                x = at[x]
            return x

        for a, b in edges:
            at[max(top(a), top(b))] = min(top(a), top(b))
        least = {}
        for i in sorted(fp):
            least.setdefault(top(fp[i]), i)
        assert {i for i in fp if least[top(fp[i])] == i} == brute_kept(rows)
        assert most < 100 or len(edges) < 1000  # of 4950 and 1770 pairs


def test_sketches_share_enough():
    rng = np.random.default_rng(1)
    for a, b, both in ((10, 10, 9), (40, 50, 40), (48, 60, 48), (50, 40, 40), (60, 60, 54), (300, 300, 267), (400, 500, 400)):
        assert both / (a + b - both) >= 0.8
        for _ in range(300):
            h = rng.integers(0, 1 << 63, a + b - both)
            x, y = np.sort(h[:a])[: similar.SKETCH], np.sort(h[a - both :])[: similar.SKETCH]
            shared = len(np.intersect1d(x, y))
            assert shared >= min(similar.surely_shared(a), similar.surely_shared(b))


def test_one_document_of_each_group_stays(spark):
    text = prose(random.Random(4), 60)
    rows = [(1, text, "a", "s", 1), (1, text + " x", "b", "s", 1), (2, text, "c", "s", 1), (None, text, "d", "s", 1), (7, "alone", "e", "s", 1), (7, "alone", "f", "s", 1)]
    got = simhash_dedup.drop_near(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 7]
