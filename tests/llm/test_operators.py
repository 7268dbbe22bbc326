"""Operators against brute force, libraries, exact round trips and held-out accuracy."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_fixtures import SCHEMA, WORDS, crc, prose
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from docloom.llm import components, decontamination, exact_dedup, language, quality, queries, sentencepiece_fst, sharding, simhash_dedup, token_count, toxicity, url_filter
from docloom.llm.common import lookup, tokenizer_path, without

PIECES, BPE = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


# ---- 1 sharding


def test_shards(spark, hostile):
    rows = sharding.shard_documents(hostile, 24).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key" and r["grown_shard"] in (r["shard"], 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    first = {r["doc_id"]: r["shard"] for r in rows}
    assert all(first[r["doc_id"]] == r["shard"] for r in rows)  # the id decides
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["size"] == 8 and by_id[0]["size"] == 8 and by_id[3]["size"] == 12 and by_id[3]["text_crc32"] == crc("word")


def test_shards_against_brute_force(spark):
    """Scores worked out row by row: XXH64 of the key, seeded by the hash of what comes before as Spark chains it."""
    ids = [0, 1, 7, -3, 12345678901, None]
    weights = [1.0, 2.0, 0.0, 0.5, 1.0]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id bigint")
    got = [r[0] for r in df.select(sharding.shard_of(F.col("doc_id"), weights)).collect()]
    for i, shard in zip(ids, got):
        scores = {}
        for k, w in enumerate(weights):
            first = xxh64_intdigest(("\x00null" if i is None else str(i)).encode(), 42)
            h = xxh64_intdigest_of_int(k, first) >> 12
            scores[k] = -w / np.log((h + 0.5) * 2.0**-52)
        assert shard == max(sorted(scores), key=scores.get)


def xxh64_intdigest_of_int(value, seed):
    """Spark hashes an int as four bytes by the tail rounds of XXH64."""
    mask, p1, p2, p3, p5 = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (seed + p5 + 4) & mask
    h ^= ((value & 0xFFFFFFFF) * p1) & mask
    h = ((h << 23 | h >> 41) & mask) * p2 + p3 & mask
    h = (h ^ h >> 33) * p2 & mask
    h = (h ^ h >> 29) * p3 & mask
    return h ^ h >> 32


def test_weights_and_growth(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    count = lambda w: Counter({r[0]: r[1] for r in sharding.assign_shards(ids, "doc_id", w).groupBy("shard").count().collect()})
    n = count([1.0, 2.0, 0.0, 1.0])
    assert 2 not in n and abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    pair = ids.select(sharding.shard_of(F.col("doc_id"), [1.0] * 24).alias("a"), sharding.shard_of(F.col("doc_id"), [1.0] * 25).alias("b")).filter("a <> b")
    moved = pair.count()
    assert pair.filter("b <> 24").count() == 0 and abs(moved / 20_000 - 1 / 25) < 0.01
    with pytest.raises(ValueError):
        sharding.shard_of(F.col("doc_id"), [0.0])


# ---- 3 SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hs = [xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius=3):
    at = list(range(len(fps)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                at[top(i)] = top(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[top(i)] = min(least.get(top(i), x), x)
    return [least.get(top(i)) for i in range(len(fps))]


def test_near_copies_against_brute_force(spark, hostile, sf):
    extra = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars")
    docs = hostile.unionByName(extra)
    rnd = random.Random(2)
    base = [prose(rnd, 150).split() for _ in range(8)]
    near = []
    for k, w in enumerate(base):
        for c in range(6):
            v = list(w)
            for _ in range(c % 3):
                v[rnd.randrange(len(v))] = rnd.choice(WORDS)
            near.append((5000 + 10 * k + c, " ".join(v), "en", "s", 1))
    docs = docs.unionByName(spark.createDataFrame(near, SCHEMA))
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    want = Counter((r["doc_id"], f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps)))
    got = Counter(tuple(r) for r in simhash_dedup.near_report(docs).collect())
    assert got == want
    assert any(c != i for i, _, c in got if i and i >= 5000)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_sliced_links(radius):
    rng = np.random.default_rng(radius)
    fps = {int(x) for x in rng.integers(0, 2**63, 60)}
    for x in list(fps)[:30]:
        for _ in range(5):
            y = x
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    a = np.array(sorted(fps), np.uint64)
    rng.shuffle(a)
    cut = len(a) // 3
    first, last = np.r_[np.zeros(cut, int), np.full(len(a) - cut, cut)], np.r_[np.full(cut, cut), np.full(len(a) - cut, len(a))]
    got = set()
    for i, j in simhash_dedup.sliced_links(a, first, last, radius):
        got |= set(zip(i.tolist(), j.tolist()))
    same = lambda i, j: (i < cut) == (j < cut)
    assert got == {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if same(i, j) and bin(int(a[i]) ^ int(a[j])).count("1") <= radius}


def test_split_buckets_lose_no_link(spark):
    rng = np.random.default_rng(4)
    common = int(rng.integers(0, 2**63))
    fps = {common ^ int(x) for x in rng.integers(0, 2**14, 700)} | {int(x) for x in rng.integers(0, 2**63, 200)}  # one crowded corner
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    ends = lambda rows: {r["node"]: r["root"] for r in components.components(rows).collect()}
    few = ends(simhash_dedup.links(df, bucket_rows=150))
    one = ends(simhash_dedup.links(df, bucket_rows=10**9))
    want = brute_components(list(fps), [x & (2**64 - 1) for x in fps])
    assert few == one and {k for k, c in zip(fps, want)} >= set(few)
    groups = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert groups(few) == {g for g in groups(dict(zip(fps, want))) if len(g) > 1}


def test_components_of_a_long_chain(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1001), (1001, 1000), (-5, -5)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert components.components(edges.limit(0)).collect() == []
    by_rounds = {r["node"]: r["root"] for r in components.components(edges, few=0).collect()}
    assert by_rounds == got and components.components(edges.limit(0), few=-1).collect() == []


# ---- 5 URLs


def test_bloom_passes_every_listed_url(spark):
    keys = spark.range(3000).select(F.concat(F.lit("h.com/"), "id").alias("k"))
    urls = spark.range(1000, 9000).select(F.concat(F.lit("h.com/"), "id").alias("u")).unionByName(spark.createDataFrame([("h.com/1",)] * 50 + [(None,)], "u string"))
    got = {r["u"] for r in url_filter.listed_among(urls, "u", keys.unionByName(keys), "k").collect()}
    assert got == {f"h.com/{i}" for i in [1, *range(1000, 3000)]}
    small = url_filter.bloom(keys, "k", 72)
    assert small.count() == 72 and small.select(F.bit_count("w0")).agg(F.max("bit_count(w0)")).first()[0] < 64


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


# ---- 7 SentencePiece and 9 token counts


def odd_texts():
    rnd = random.Random(3)
    marks = list("abc  \t\n\r\x1c\x1f\x0b\x85\xa0\u200b\u3000'sétéßÄ123٣४$$!.-中文字가힣😀\u0301theTHE")
    out = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    out += ["".join(rnd.choice(["the", "ing", " ", "  ", "er", "on", "tion", "qu", "é", "0", "1", "\n"]) for _ in range(rnd.randint(0, 30))) for _ in range(1500)]
    return [*out, "", " ", "   ", "a" * 3000, " " * 100, " " * 5000 + "x", "x<|endoftext|> y<|endoftext|>", "▁▁▁ a", "a" + " " * 13 + "b", "中" * 200, "ab" * 3000]


def test_token_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    texts = odd_texts()
    want = [len(e.ids) for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in token_count.token_counts(docs, BPE).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (want[i] > 1024) for i, t in enumerate(texts))


def test_proved_tokens_and_a_full_memory(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_count, "REMEMBERED", 50)
    c = token_count.Counter(BPE)
    library = Tokenizer.from_file(BPE)
    assert c.whole > 40_000 and all(len(library.encode(w).ids) == 1 for w in random.Random(1).sample(sorted(c), 300) if "<|" not in w and len(re.findall(r"\s", w)) < 2)
    words = ["".join(random.Random(i).choice("abcdefgh") for _ in range(9)) for i in range(200)]
    for _ in range(2):
        assert [c[w] for w in words] == [len(library.model.tokenize(w)) for w in words]
    assert len(c) <= c.whole + 51


def test_pieces_equal_the_library_and_come_back(spark):
    from sentencepiece import SentencePieceProcessor

    texts = odd_texts()
    want = SentencePieceProcessor(model_file=PIECES).encode(texts, num_threads=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in sentencepiece_fst.encode_documents(docs, PIECES).collect()}
    for i, t in enumerate(texts):
        assert list(got[i]["token_ids"]) == want[i], t[:80]
        assert got[i]["round_trip"] == ("▁" not in t) and got[i]["decoded_crc32"] == crc(t.replace("▁", " "))


def test_weights_agree_with_merging(monkeypatch):
    monkeypatch.setattr(sentencepiece_fst, "REMEMBERED", 20)
    t = sentencepiece_fst.Transducer(PIECES)
    rnd = random.Random(9)
    pieces = [p for p in t.id_of if "▁" not in p[1:]]
    for _ in range(3000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        if not b.startswith("▁"):
            assert (t.weight(a, b) == 0.0) == (t.merged(a + b) == [a, b]), (a, b)
    assert t.shortest("") == [] and t.ids(t.shortest("\U0001f9ff")) == [t.byte_id[b] for b in "\U0001f9ff".encode()]


# ---- 8 exact copies


def test_copies(spark, hostile):
    kept = exact_dedup.drop_copies(hostile).collect()
    best = {}
    for r in hostile.collect():
        k = r["text"] or ""
        best[k] = max((x for x in (best.get(k), r["doc_id"]) if x is not None), default=None)
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == Counter((i, t) for t, i in best.items())


def test_hot_digests_and_lookup(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = exact_dedup.dedup_report(rows)
    assert got.filter("kept").count() == 4000 - 1334 + 1 and got.filter("group_size = 1334").select("keep_id").distinct().collect() == [(3999,)]
    table = rows.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    assert lookup(rows, table, "text", "n", 4000).filter("n IS NULL").count() == 0
    assert lookup(rows.unionByName(spark.createDataFrame([(1, None)], "doc_id bigint, text string")), table, "text", "n", 4001).count() == 4001


def test_index_persists(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = lambda *rows: spark.createDataFrame(list(rows), "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, path, 4)
    assert sorted(r[0] for r in index.admit(batch((1, "a"), (2, "a"), (3, "b"), (3, "b"), (4, None)), "one").collect()) == [2, 3, 4]
    index.close()
    again = exact_dedup.DigestIndex(spark, path, 16)
    assert again.rows().count() == 3 and again.buckets == 4
    assert [r[0] for r in again.admit(batch((9, "b"), (8, "c"), (7, "")), "two").collect()] == [8]
    assert again.admit(batch((5, "zz")).limit(0), "three").count() == 0 and again.rows().count() == 4
    plan = again.new_rows(batch((1, "q")).select(exact_dedup.digest().alias("digest")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the index side isn't shuffled
    report = {r["doc_id"]: r for r in exact_dedup.dedup_report(batch((20, "a"), (21, "new"), (22, "new")), again, "four").collect()}
    assert [(report[i]["keep_id"], report[i]["kept"]) for i in (20, 21, 22)] == [(2, False), (22, False), (22, True)]


def test_reopened_with_other_buckets(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    for made, opened in ((8, 4), (4, 8)):
        exact_dedup.DigestIndex(spark, f"{tmp_path}/{made}", made).admit(docs, "one")
        index = exact_dedup.DigestIndex(spark, f"{tmp_path}/{made}", opened)
        assert index.rows().count() == 200 and index.admit(docs, "two").count() == 0 and index.rows().count() == 200


def test_a_batch_run_again_loses_and_repeats_nothing(spark, tmp_path):
    docs = spark.createDataFrame([("x", "a"), ("y", "a"), ("z", "b")], "doc_id string, text string")  # text ids
    index = exact_dedup.DigestIndex(spark, str(tmp_path), 4)
    index.admit(docs.filter("doc_id = 'z'"), "zero")
    want = [("y", "a")]
    assert [tuple(r) for r in index.admit(docs, "one").collect()] == want  # its rows may be lost behind this
    assert [tuple(r) for r in index.admit(docs, "one").collect()] == want and index.rows().count() == 2
    assert index.admit(docs, "two").count() == 0
    both = docs.unionByName(spark.createDataFrame([("w", "c"), ("v", "b")], docs.schema))
    halves = exact_dedup.DigestIndex(spark, f"{tmp_path}/halves", 4)
    parts = [halves.admit(both.filter(f"doc_id {c} 'y'"), c).collect() for c in ("<", ">=")]
    assert sorted(r["text"] for x in parts for r in x) == sorted(r["text"] for r in exact_dedup.drop_copies(both).collect()) == ["a", "b", "c"]


def test_copies_of_one_row(spark):
    rows = [(1, "a")] * 3 + [(0, "a"), (None, "a"), (None, "b"), (None, "b")]
    got = exact_dedup.dedup_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    key = lambda x: -1 if x is None else x
    assert sorted((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [
        (-1, -1, 2, False), (-1, -1, 2, True), (-1, 1, 5, False), (0, 1, 5, False), (1, 1, 5, False), (1, 1, 5, False), (1, 1, 5, True)
    ]


def test_without(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, None)], "doc_id bigint, text string")
    ids = docs.filter("text = 'a' OR text IS NULL").select(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    assert sorted(r["text"] for r in without(docs, ids).collect()) == ["b", "c"]


# ---- 10 decontamination


def brute_leaks(docs, items):
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for item_id, text in items:
        w = words(text)
        k = min(5, len(w))
        if not k:
            continue
        cut = lambda x: [tuple(x[i : i + k]) for i in range(len(x) - k + 1)]  # noqa: E731, B023
        item, m = Counter(cut(w)), len(cut(w))
        for doc_id, body in docs:
            s = cut(words(body))
            for at in range(max(1, len(s) - m + 1)):
                own = Counter(s[at : at + m])
                both = sum((own & item).values())
                sim = both / (m + sum(own.values()) - both)
                if sim >= 0.8 - 1e-12 and sim > out.get((doc_id, item_id), (0, 0))[0]:
                    out[doc_id, item_id] = (sim, at)
    return out


def test_leaks_against_brute_force(spark):
    rnd = random.Random(21)
    items = [(i, prose(rnd, rnd.choice([1, 3, 4, 5, 6, 12, 25, 40, 80]))) for i in range(40)] + [(90, None), (91, "..."), (92, "loop " * 12)]
    docs = [(i, prose(rnd, rnd.choice([0, 2, 30, 200]))) for i in range(60)]
    for i in range(60, 220):
        w = rnd.choice(items[:40])[1].split()
        for _ in range(rnd.choice([0, 1, 1, 1, 2, 3])):
            at = rnd.randrange(len(w) + 1)
            w = rnd.choice([w[:at] + [rnd.choice(WORDS)] + w[at:], w[:at] + w[at + 1 :], w[:at] + [rnd.choice(WORDS)] + w[at + 1 :]])
        before, after = prose(rnd, rnd.choice([0, 3, 50])), prose(rnd, rnd.choice([0, 3, 50]))
        docs.append((i, f"{before} {' '.join(w).title()}, {after}"))
    docs += [(300, "Loop loop " * 30), (301, None), (302, "")]
    want = brute_leaks(docs, items)
    assert sum(s < 1 for s, _ in want.values()) > 5
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for part in (250_000, 300):  # whole, and in several parts
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontamination.leaks(d, b, part_shingles=part).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] >= want[k][1] for k in want)
    assert decontamination.leaks(d, b.limit(0)).collect() == []
    assert decontamination.drop_leaks(d, b).count() == len(docs) - len({i for i, _ in want})


# ---- 2, 4, 6: what is learnt holds on held-out rows


def test_quality_on_held_out_rows(spark):
    rnd = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = rnd.random() < 0.7
        rows.append((i, prose(rnd, rnd.randint(20, 300)) if good else " ".join(w + rnd.choice(["$$$", "%%%", "!!"]) for w in prose(rnd, rnd.randint(20, 300)).upper().split()), "en", "s", 1))
        labels.append((i, int(good), 0))
    got = quality.quality_scores(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).filter("held_out").collect()
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in got]) > 0.98
    hidden = spark.createDataFrame([(i, q if crc(i) % 5 else 1 - q, t) for i, q, t in labels], "doc_id bigint, quality int, toxic int")
    again = quality.quality_scores(spark.createDataFrame(rows, SCHEMA), hidden).collect()
    assert {r["doc_id"]: r["score"] for r in again if r["held_out"]} == {r["doc_id"]: r["score"] for r in got}  # held-out labels aren't read


def test_toxicity_learns_an_interaction(spark):
    rnd = random.Random(7)
    insults, groups = ["vermin", "filth", "scumbag", "rotten"], ["zorgs", "blips", "quonks"]
    rows, labels = [], []
    for i in range(1600):
        w = prose(rnd, 25).split()
        kind = rnd.choice(["none", "insult", "group", "both"])
        if kind in ("insult", "both"):
            w.insert(rnd.randrange(len(w)), rnd.choice(insults))
        if kind in ("group", "both"):
            w.insert(rnd.randrange(len(w)), rnd.choice(groups))
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(kind == "both")))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity_scores(d, lab).filter("held_out").collect()
    assert np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in got]) > 0.97
    kept = toxicity.drop_toxic(d, lab)
    assert kept.columns == d.columns and 0.7 < kept.count() / 1600 < 0.8


def brute_bytes(text):
    """Lower-case letters in UTF-8, runs of anything else as one zero byte."""
    folded = [c.lower() if len(c.lower()) == 1 else c for c in text]
    return re.sub("\0+", "\0", "".join(f if c.isalpha() else "\0" for c, f in zip(text, folded))).encode()


def brute_phrases(own, reference, known):
    """Phrases of a lane: the longest that the reference holds; a byte that it lacks is no phrase of its own but ends one."""
    n, state = 0, b""
    for c in own:
        c = bytes([c]) if c in known or not c else b"\xff"
        if state + c in reference:
            state += c
        else:
            n += 1
            state = c if c in reference else b""
    return n + bool(state)


def test_cross_parsing_against_brute_force():
    """Phrases over lane borders, the costs and the winner, in scripts of one to four bytes a letter."""
    rnd = random.Random(8)
    scripts = {"han": range(0x4E00, 0x5200), "hangul": range(0xAC00, 0xB100), "deseret": range(0x10428, 0x10450), "greek": range(0x3B1, 0x3C9)}
    write = lambda k, n: " ".join("".join(chr(rnd.choice(scripts[k])) for _ in range(rnd.randint(1, 4))) for _ in range(n))
    samples = {k: [write(k, 150) for _ in range(3)] for k in scripts} | {"xx": [prose(rnd, 200)], "yy": [" ".join("aeiou"[rnd.randrange(5)] * 2 + rnd.choice("bcdfg") for _ in range(300))]}
    model = language.fit(samples)
    parser = language.Parser(model)
    texts = [prose(rnd, 300), "aab eec iid!! oof", "ZZZ qqq", "", "ÀÉ ß Ǆ İ", "a", "1 2", *(write(k, n) for k in scripts for n in (3, 200)), *(samples[k][0][100:700] for k in scripts)]
    found, sizes, _ = parser.phrases(texts)
    names, scores = parser.judge(texts)
    for i, t in enumerate(texts):
        own, cost = brute_bytes(t), {}
        assert len(own) == sizes[i]
        for k, lang in enumerate(model.languages):
            ref = language.reference_of(samples[lang], language.REFERENCE).tobytes()
            n = sum(brute_phrases(own[a : a + language.LANE], ref, model.alphabet) for a in range(0, len(own), language.LANE))
            assert found[k][i] == n, (lang, t[:50])
            cost[lang] = n * np.log2(len(ref)) / max(1, len(own))
        has = any(c.isalpha() for c in t)
        assert names[i] == (min(sorted(cost), key=cost.get) if has else "und") and 0 <= scores[i] <= 1
    assert names[-4:] == list(scripts) and all(len(model.languages) == 6 for _ in names)


def test_languages_on_held_out_rows(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.filter("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    odd = spark.createDataFrame([(1, "123 !!", None, None, None), (2, None, None, None, None), (3, "中文", None, None, None), *((i, "the and of", "en", None, None) for i in range(10, 20)), *((i, "le et de", "fr", None, None) for i in range(20, 30))], SCHEMA)
    by = {r["doc_id"]: r["lang_pred"] for r in language.languages(odd).collect()}
    assert by[1] == by[2] == "und" and by[3] in ("en", "fr")


def test_long_texts_count_whole(spark):
    """What stands at a long text's end counts: lanes and chunks cover all of it."""
    samples = {"xx": [prose(random.Random(1), 300)], "yy": ["aab eec iid oof uug " * 60]}
    p = language.Parser(language.fit(samples))
    tail = prose(random.Random(2), 100) + " " + "aab eec iid oof uug " * 2000
    assert p.judge([tail])[0] == ["yy"]
