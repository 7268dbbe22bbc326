"""What the fits learn from: interactions, repeated and missing labels, copies, long texts, many letters and languages."""

import random

import numpy as np
import pytest
from llm_fixtures import SCHEMA, prose
from pyspark.sql import functions as F

from docloom.llm import language, quality, toxicity
from docloom.llm.common import labelled_sample

LABELS = "doc_id bigint, quality int, toxic int"


@pytest.mark.parametrize("rule", ["one of two", "both or neither"])
def test_an_interaction_without_single_effects(spark, monkeypatch, rule):
    rnd = random.Random(7)
    rows, labels = [], []
    for i in range(1600):
        w = prose(rnd, 25).split()
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        for word, there in (("vermin", a), ("zorgs", b)):
            if there:
                w.insert(rnd.randrange(len(w)), word)
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int((a != b) == (rule == "one of two"))))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    right = lambda: np.mean([r["predicted"] == labels[r["doc_id"]][2] for r in toxicity.toxicity_scores(d, lab).filter("held_out").collect()])
    assert right() > 0.95
    fit = toxicity.fit

    def additive(*args):
        sums = toxicity.Incidence.sums
        monkeypatch.setattr(toxicity.Incidence, "sums", lambda self, values: sums(self, values) if values.ndim == 1 else np.zeros((self.n, values.shape[1])))
        m = fit(*args)
        monkeypatch.undo()
        return toxicity.Model(m.w0, m.terms, m.w, 0 * m.v)

    monkeypatch.setattr(toxicity, "fit", additive)
    assert right() < 0.65


def test_labelled_samples(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", 1) for i in range(100)] + [(7, f"other {k}", "en", "s", 1) for k in range(5000)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20_100)], LABELS)
    sample, stands_for = labelled_sample(docs, labels, "quality", F.lit(True), 3000)
    assert sample.count() == 100 and stands_for == {1: 1.0}  # labels without a document take no one's place
    sample, stands_for = labelled_sample(docs, labels, "quality", F.lit(True), 10)
    assert sample.count() == 10 == sample.select("doc_id").distinct().count() and stands_for == {1: 10.0}
    one = labelled_sample(docs.filter("doc_id = 7"), labels, "quality", F.lit(True), 10)[0]
    assert one.count() == 1 == labelled_sample(docs.filter("doc_id = 7").unionByName(docs), labels.filter("doc_id = 7"), "quality", F.lit(True), 10)[0].count()


def test_long_texts_are_learnt(spark):
    """All labelled texts are over the piece that quality takes of each; toxicity takes them whole."""
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(60):
        bad = i % 2
        w = prose(rnd, 5000).split()
        if bad:
            w = [x.upper() + "$$$" for x in w[:-1]] + ["vermin"]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1 - bad, bad))
    d, lab = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, LABELS)
    assert min(len(r[1]) for r in rows) > quality.MAX_CHARS
    for got, at in ((quality.quality_scores(d, lab), 1), (toxicity.toxicity_scores(d, lab), 2)):
        assert all(r["predicted"] == labels[r["doc_id"]][at] for r in got.collect())


def test_languages_of_many_letters(spark):
    """Two languages of one script with thousands of letters are told apart on held-out texts."""
    rnd = random.Random(5)
    han = [chr(c) for c in range(0x4E00, 0x5A00)]
    rnd.shuffle(han)
    words = {"zh": [han[i] + han[i + 1] for i in range(0, 1800, 2)], "ja": [han[i] + han[i + 1] for i in range(1, 1800, 2)], "en": prose(rnd, 50).split()}
    rows = [(i, " ".join(rnd.choice(words[k]) for _ in range(60)), k, "s", 1) for i, k in enumerate(rnd.choice(sorted(words)) for _ in range(600))]
    got = language.languages(spark.createDataFrame(rows, SCHEMA)).filter("held_out").collect()
    assert np.mean([r["lang_pred"] == rows[r["doc_id"]][2] for r in got]) > 0.97


def test_over_two_hundred_languages():
    rnd = random.Random(6)
    samples = {f"l{i:03}": [" ".join("".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(40))] for i in range(230)}
    parser = language.Parser(language.fit(samples))
    assert parser.judge([samples["l007"][0], samples["l229"][0]])[0] == ["l007", "l229"]


def test_groups_of_tables(monkeypatch):
    samples = {"xx": [prose(random.Random(1), 100)], "yy": ["aab eec iid oof uug " * 30], "zz": ["zyq wxy qzx " * 30]}
    texts = [prose(random.Random(2), 50), "aab oof uug", "qzx zyq", "none of it"]
    one = language.Parser(language.fit(samples)).phrases(texts)[0]
    monkeypatch.setattr(language, "CELLS", 30_000)
    model = language.fit(samples)
    assert len(model.tables) > 1 and (language.Parser(model).phrases(texts)[0] == one).all()


def test_references_come_from_all_texts():
    texts = ["a" * 50, "b" * 5000, "c" * 5000]
    own = language.reference_of(texts, 3000)
    n = np.bincount(own, minlength=128)
    assert n[ord("a")] == 50 and n[ord("b")] == n[ord("c")] == 1475


def test_calibration_against_brute_force():
    """Isotonic regression as the least squares fit over all rising steps, checked by pooling any split that falls."""
    rng = np.random.default_rng(3)
    d, w = np.round(rng.normal(size=60), 1), rng.uniform(0.5, 2, 60)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * d))).astype(float)
    at, score = quality.calibrated(d, y, w)
    assert (np.diff(at) > 0).all() and (np.diff(score) >= 0).all() and 0 < score.min() and score.max() < 1
    order = np.argsort(d, kind="stable")
    yy, ww = y[order], w[order]
    mean = lambda a, b: (yy[a:b] * ww[a:b]).sum() / ww[a:b].sum()
    want = [max(min(mean(a, b) for b in range(i + 1, 61)) for a in range(i + 1)) for i in range(60)]  # the max-min formula
    levels = sorted(set(np.round(want, 9)))
    assert len(levels) == len(score)
    assert quality.calibrated(np.zeros(0), np.zeros(0), np.zeros(0))[1].tolist() == [0.5]


def test_differences_against_brute_force():
    import zstandard as zstd

    good, bad = prose(random.Random(1), 400).encode(), b"JUNK %%% " * 300
    sizes = quality.Sizes(good, bad)
    for text in ("", "x", prose(random.Random(2), 900), "JUNK %%% " * 500, "é" * 3000):
        data, n = text.encode(), {}
        for name, d in (("good", good), ("bad", bad)):
            c = zstd.ZstdCompressor(level=quality.LEVEL, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            n[name] = sum(len(c.compress(data[i : i + quality.CHUNK])) for i in range(0, len(data), quality.CHUNK))
        assert abs(sizes.difference(text) - (n["bad"] - n["good"]) / max(1, len(data))) < 0.02


def test_margins_against_brute_force():
    """The machine's margin summed pair by pair, and pairs' gains from their tables."""
    rng = np.random.default_rng(0)
    model = toxicity.Model(0.3, np.array(sorted({t for w in "red green blue stone".split() for t in toxicity.terms_of(w)})), rng.normal(size=6), rng.normal(size=(6, 4)))
    text = "Red stone, red unknown GREEN"
    on = [i for i, t in enumerate(model.terms) if t in set(toxicity.terms_in(text).tolist())]
    want = 0.3 + sum(model.w[i] for i in on) + sum(model.v[i] @ model.v[j] for i in on for j in on if i < j)
    assert len(model.terms) == 6 and abs(toxicity.Scorer(model).margin(text) - want) < 1e-9
    lists = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(300)]
    y = np.array([int((1 in x) != (4 in x)) for x in lists])
    assert toxicity.interacting(lists, y, np.arange(6)).tolist() == [1, 4]


def test_incidence_against_a_matrix():
    """Terms of many texts and of few, and none at all of either sort."""
    rng = np.random.default_rng(4)
    for often in (0.0, 0.4, 1.0):
        full = rng.random((300, 12)) < np.where(np.arange(12) < often * 12, 0.5, 0.01)
        rows, terms = np.nonzero(full)
        x = toxicity.Incidence(terms, rows, 300, 12)
        v, g = rng.normal(size=(12, 3)), rng.normal(size=(300, 3))
        for got, want in ((x.sums(v), full @ v), (x.sums(v[:, 0]), full @ v[:, 0]), (x.back(g), full.T @ g), (x.back(g[:, 0]), full.T @ g[:, 0])):
            assert np.abs(got - want).max() < 1e-4
