"""Quality by compression: zstandard dictionaries of good and bad text, their size difference as a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, labelled_sample, piece_of

#: Texts are compressed in pieces of CHUNK bytes, so that the dictionary counts at the end of a long text as at its start.
CHUNK, LEVEL, DICTIONARY = 2048, 3, 1 << 19
#: Labelled documents of each class that are fitted on at most; of a longer one a piece of MAX_CHARS characters is.
PER_CLASS, MAX_CHARS = 3000, 20_000
THRESHOLD = 0.3


@dataclass
class Model:
    """score = the value at d, the normalised size difference, of the line through the points (at, score)."""

    good: bytes
    bad: bytes
    at: np.ndarray
    score: np.ndarray


def chunks(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)] or [b""]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; with too little text to train on, the end of the text itself."""
    parts = [c for t in texts for c in chunks(t) if c]
    try:
        return zstd.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstd.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


class Sizes:
    """Texts compressed under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self.compress = []
        for d in (good, bad):
            data = zstd.ZstdCompressionDict(d or b" ")
            data.precompute_compress(level=LEVEL)
            self.compress.append(zstd.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress)

    def difference(self, text: str | None) -> float:
        """(bad - good size) a byte of text, summed over the pieces; 0 for an empty text."""
        data = (text or "").encode("utf-8", "surrogatepass")
        good, bad = self.compress
        return sum(len(bad(c)) - len(good(c)) for c in chunks(data)) / len(data) if data else 0.0


def calibrated(d: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising line from differences d to the share of label 1: isotonic regression of y with weights w.

    Each level of the regression is a point at its mean difference; half a row of either class is added to each, so that no
    score is 0 or 1.  Without rows every score is one half.
    """
    if not len(d):
        return np.zeros(1), np.full(1, 0.5)
    levels: list[list[float]] = []  # weight, that of label 1, weighted sum of differences
    order = np.argsort(d, kind="stable")
    for x, label, weight in zip(d[order], y[order], w[order]):
        levels.append([weight, weight * label, weight * x])
        while len(levels) > 1 and levels[-2][1] * levels[-1][0] >= levels[-1][1] * levels[-2][0]:
            last = levels.pop()
            levels[-1] = [a + b for a, b in zip(levels[-1], last)]
    total, ones, sums = np.array(levels).T
    half = 0.5 * w.mean()
    return sums / total, (ones + half) / (total + 2 * half)


def fit(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Dictionaries from half of the texts, calibration on the other half."""
    half = np.arange(len(texts)) % 2 == 0
    of = lambda k: [texts[i].encode("utf-8", "surrogatepass") for i in np.flatnonzero(half & (labels == k))]
    good, bad = dictionary(of(1)), dictionary(of(0))
    sizes = Sizes(good, bad)
    d = np.array([sizes.difference(texts[i]) for i in np.flatnonzero(~half)], float)
    return Model(good, bad, *calibrated(d, labels[~half].astype(float), weights[~half]))


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, label: str = "quality", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Model:
    """The driver gets at most 2 * per_class texts of max_chars characters."""
    sample, stands_for = labelled_sample(docs, labels, label, may_learn, per_class)
    pdf = sample.withColumn("text", piece_of(F.col("text"), max_chars, F.col("doc_id"))).toPandas().sort_values("doc_id")
    y = pdf["label"].to_numpy(int)
    # shuffled by a fixed permutation, so the halves don't depend on the order of ids
    order = np.random.default_rng(0).permutation(len(pdf))
    texts = pdf["text"].tolist()
    return fit([texts[i] for i in order], y[order], np.array([stands_for.get(k, 1.0) for k in y[order]]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: the probability of label 1, from the whole text alone.  Null and empty texts share one score."""
    kept: dict = {}
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        sizes = kept.setdefault("sizes", Sizes(m.good, m.bad)) if not kept else kept["sizes"]
        for b in batches:
            p = np.interp(np.array([sizes.difference(t.as_py()) for t in b.column(1)], float), m.at, m.score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Labels are learnt from ids whose crc32 modulo 5 isn't 0.  A null id is scored as any other and held out if its crc
    (of the empty text) says so.  Without labels of either class every score is one half or so; nothing fails.
    """
    held_out = crc_of_id() % 5 == 0
    model = learn(docs, labels, ~held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
