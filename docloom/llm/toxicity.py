"""Toxicity by a factorization machine over hashed terms, which learns pairwise interactions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, labelled_sample, lean, written

#: Terms are hashed to BUCKETS; words and their first 4 and 6 letters are terms.
BUCKETS, PREFIXES = 1 << 20, (4, 6)
#: Terms enter the machine that occur in LEAST_TEXTS texts and tell the classes apart alone (log-likelihood ratio), or in a
#: pair by LEAST_GAIN more than its terms do alone.  Pairs are counted of the PAIR_TERMS terms that split the texts most
#: evenly; of the others at most MOST_TERMS enter.
LEAST_RATIO, LEAST_TEXTS, LEAST_GAIN, PAIR_TERMS, MOST_TERMS = 8.0, 2, 40.0, 2048, 20_000
FACTORS, STEPS, RATE, L1, L2 = 4, 150, 0.15, 1e-4, 1e-2
#: Labelled documents of each class that are fitted on at most.
PER_CLASS = 6000
THRESHOLD = 0.3
#: Words whose terms a worker remembers before it starts afresh.
REMEMBERED = 300_000

WORDS = re.compile(r"[^\W\d_]+").findall


def terms_of(word: str) -> list[int]:
    """The buckets of a lower-case word: itself and, where longer, its prefixes, hashed with their length."""
    out = [crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS]
    for k in PREFIXES:
        if len(word) > k:
            out.append(crc32(b"%d^" % k + word[:k].encode("utf-8", "surrogatepass")) % BUCKETS)
    return out


def terms_in(text: str | None) -> np.ndarray:
    """The distinct buckets of a text; each counts once, however often it occurs."""
    out: set[int] = set()
    for w in set(WORDS((text or "").lower())):
        out.update(terms_of(w))
    return np.fromiter(sorted(out), np.int64, len(out))


@dataclass
class Model:
    """Score = w0 + sum w + half of (|sum v|^2 - sum |v|^2) over the terms present; terms not in `terms` count nothing."""

    w0: float
    terms: np.ndarray
    w: np.ndarray
    v: np.ndarray


class Incidence:
    """Which of k terms are in which of n texts (pairs of rows and terms): terms of many texts as a matrix, the others as a list."""

    def __init__(self, terms: np.ndarray, rows: np.ndarray, n: int, k: int):
        self.n, self.k = n, k
        self.often = np.flatnonzero(np.bincount(terms, minlength=k) * 32 >= n)
        at = np.full(k, -1, np.int32)
        at[self.often] = np.arange(len(self.often))
        dense = at[terms] >= 0
        self.matrix = np.zeros((n, len(self.often)), np.float32)
        self.matrix[rows[dense], at[terms[dense]]] = 1
        self.terms, self.rows = terms[~dense], rows[~dense]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By text, the values of its terms added up; values may have several columns."""
        if values.ndim > 1:
            return np.stack([self.sums(x) for x in values.T], 1)
        return np.bincount(self.rows, values[self.terms], self.n) + self.matrix @ values[self.often].astype(np.float32)

    def back(self, values: np.ndarray) -> np.ndarray:
        """By term, the values of its texts added up."""
        if values.ndim > 1:
            return np.stack([self.back(x) for x in values.T], 1)
        out = np.bincount(self.terms, values[self.rows], self.k).astype(float)  # of no values at all it would be whole numbers
        out[self.often] = values.astype(np.float32) @ self.matrix
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _part(seen, row, col, n):
    """seen * ln(seen * n / (row * col)), 0 where nothing is seen: a cell's part of half a log-likelihood ratio."""
    return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) * n / np.maximum(row * col, 1e-9)), 0)


def told_apart(present: Column, in_toxic: Column, n: int, toxic: int) -> Column:
    """The log-likelihood ratio of a term's two-by-two table."""
    cells = [
        (in_toxic, present, toxic),
        (present - in_toxic, present, n - toxic),
        (F.lit(toxic) - in_toxic, F.lit(n) - present, toxic),
        (F.lit(n - toxic) - present + in_toxic, F.lit(n) - present, n - toxic),
    ]
    return 2 * sum((F.when(seen > 0, seen * F.ln(seen * F.lit(float(n)) / (row * F.lit(float(col))))).otherwise(F.lit(0.0)) for seen, row, col in cells), F.lit(0.0))


def interacting(term_lists: list[np.ndarray], labels: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Those of terms (ascending) that are in a pair which tells the classes apart by LEAST_GAIN more than its two terms do alone.

    The ratio of a pair's four-by-two table less those of its terms; a pair of which neither term means anything alone
    (one but not both, both or neither) has all of its ratio left.
    """
    k, n = len(terms), len(term_lists)
    both, toxic = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for at in range(0, n if k > 1 else 0, 512):
        x = np.zeros((min(512, n - at), k), np.float32)
        for r, own in enumerate(term_lists[at : at + 512]):
            own = own[np.isin(own, terms)]
            x[r, np.searchsorted(terms, own)] = 1
        both += x.T @ x
        x = x[labels[at : at + 512] == 1]
        toxic += x.T @ x
    present, in_toxic, n_toxic = both.diagonal().astype(float), toxic.diagonal().astype(float), float((labels == 1).sum())
    cell = lambda seen, bad: _part(bad, seen, n_toxic, n) + _part(seen - bad, seen, n - n_toxic, n)
    alone = cell(present, in_toxic) + cell(n - present, n_toxic - in_toxic)
    out = np.zeros(k, bool)
    for at in range(0, k, 64):
        i = slice(at, at + 64)
        a, b, ab = present[i, None], present[None], both[i].astype(float)
        ta, tb, tab = in_toxic[i, None], in_toxic[None], toxic[i].astype(float)
        pair = cell(ab, tab) + cell(a - ab, ta - tab) + cell(b - ab, tb - tab) + cell(n - a - b + ab, n_toxic - ta - tb + tab)
        gain = 2 * (pair - alone[i, None] - alone[None])
        gain[np.arange(gain.shape[0]), at + np.arange(gain.shape[0])] = 0
        found = gain >= LEAST_GAIN
        out |= found.any(0)
        out[i] |= found.any(1)
    return terms[out]


def fit(term_lists: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> Model:
    """The machine on the chosen terms by full gradient steps (Adam), weights soft-thresholded; deterministic."""
    n, y = len(term_lists), labels.astype(float)
    toxic = int(y.sum())
    if not n or toxic in (0, n):
        return Model(-30.0 if not toxic else 30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    terms = place[np.concatenate(term_lists)]
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in term_lists])[terms >= 0]
    terms = terms[terms >= 0]
    x = Incidence(terms, rows, n, len(chosen))
    share = weights / weights.sum()
    base = float((share * y).sum())
    w0, w = np.log(base / (1 - base)), np.zeros(len(chosen))
    v = np.random.default_rng(0).normal(0, 0.01, (len(chosen), FACTORS))
    first, second = [np.zeros_like(w), np.zeros_like(v)], [np.zeros_like(w), np.zeros_like(v)]
    for t in range(1, STEPS + 1):
        s = x.sums(v)
        g = (_sigmoid(w0 + x.sums(w) + 0.5 * ((s**2).sum(1) - x.sums((v**2).sum(1)))) - y) * share
        w0 -= 2 * g.sum()
        gw = x.back(g)
        gv = x.back(g[:, None] * s) - v * gw[:, None] + L2 / n * v
        for k, grad in enumerate((gw, gv)):
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
        scale = [RATE / (np.sqrt(x / (1 - 0.99**t)) + 1e-5) for x in second]
        w = w - scale[0] * first[0] / (1 - 0.9**t)
        w = np.sign(w) * np.maximum(np.abs(w) - scale[0] * L1, 0)
        v = v - 0.3 * scale[1] * first[1] / (1 - 0.9**t)
    return Model(float(w0), chosen, w, v)


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Terms are cut, counted and chosen on the executors; the driver gets the chosen terms of at most 2 * per_class texts.

    Long texts are learnt from whole, for a text is the set of its terms.
    """
    sample, stands_for = labelled_sample(docs, labels, label, may_learn, per_class)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([terms_in(t.as_py()).astype(np.int32) for t in b.column(1)], pa.list_(pa.int32()))], names=["label", "terms"])

    rows = written(sample.select("label", "text").mapInArrow(lean(cut), "label int, terms array<int>"), "labelled-terms")
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if toxic in (0, n):
        return fit([np.zeros(0, np.int64)] * n, np.full(n, int(toxic > 0)), np.ones(n), np.zeros(0, np.int64))
    terms = rows.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("toxic"))
    terms = terms.filter(F.col("n") >= LEAST_TEXTS).withColumn("ratio", told_apart(F.col("n"), F.col("toxic"), n, toxic))
    alone = [r[0] for r in terms.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("ratio"), "term").limit(MOST_TERMS).select("term").collect()]
    paired = [r[0] for r in terms.orderBy(F.desc(F.least(F.col("n"), F.lit(n) - F.col("n"))), "term").limit(PAIR_TERMS).select("term").collect()]
    alone, paired = (np.array(sorted(x), np.int64) for x in (alone, paired))
    some = np.union1d(alone, paired)  # fewer than 65536, so two bytes say which
    shared = docs.sparkSession.sparkContext.broadcast(some)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        place = np.full(BUCKETS, -1, np.int32)
        place[own] = np.arange(len(own))
        for b in batches:
            at = (place[x.values.to_numpy()] for x in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[x >= 0].astype(np.uint16).tobytes() for x in at], pa.binary())], names=["label", "places"])

    got = rows.mapInArrow(lean(kept), "label int, places binary").toArrow()
    labels_, lists = got.column(0).to_numpy(), [some[np.frombuffer(x.as_py(), np.uint16)].astype(np.int32) for x in got.column(1)]
    order = sorted(range(len(lists)), key=lambda i: (labels_[i], len(lists[i]), crc32(lists[i])))  # whatever the partitions
    y, lists = labels_[order], [lists[i] for i in order]
    chosen = np.union1d(alone, interacting(lists, y, paired))
    return fit(lists, y, np.array([stands_for.get(int(k), 1.0) for k in y]), chosen)


class Scorer:
    """Scores texts; the rows of a word's terms are remembered."""

    def __init__(self, model: Model):
        self.m = model
        self.place = {int(t): i for i, t in enumerate(model.terms)}
        self.none: tuple = ()
        self.memo: dict[str, tuple] = {}
        self.older: dict[str, tuple] = {}

    def places(self, word: str) -> tuple:
        out = self.older.get(word)
        if out is None:
            out = tuple(i for t in terms_of(word) if (i := self.place.get(t)) is not None) or self.none
        if len(self.memo) >= REMEMBERED:
            self.older, self.memo = self.memo, {}
        if len(word) <= 64:
            self.memo[word] = out
        return out

    def margin(self, text: str | None) -> float:
        found: set[int] = set()
        get = self.memo.get
        for w in set(WORDS((text or "").lower())):
            p = get(w)
            if p is None:
                p = self.places(w)
                get = self.memo.get
            if p:
                found.update(p)
        i = np.fromiter(sorted(found), np.int64, len(found))
        s = self.m.v[i]
        return self.m.w0 + self.m.w[i].sum() + 0.5 * float((s.sum(0) ** 2).sum() - (s**2).sum())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the probability of being toxic, from the whole text alone; null and empty texts have the base score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = _sigmoid(np.array([scorer.margin(t.as_py()) for t in b.column(1)], float))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; labels are learnt from ids whose crc32 modulo 4 isn't 2.

    Null ids and repeated rows are scored like others.  Without a toxic label every score is 0 or so, and so are all
    predictions.
    """
    held_out = crc_of_id() % 4 == 2
    model = learn(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those predicted toxic; rows go through one by one, with all their columns."""
    model = learn(docs, labels, crc_of_id() % 4 != 2)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(docs.select("text").columns[0])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            p = _sigmoid(np.array([scorer.margin(t.as_py()) for t in b.column(at)], float))
            yield b.filter(pa.array(p < THRESHOLD))

    return docs.mapInArrow(lean(judged), docs.schema)
