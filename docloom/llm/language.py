"""Language by cross-parsing: the suffix automaton that parses a text in the fewest normalised phrases wins.

Texts are read as lower-case letters in UTF-8, byte by byte, runs of anything else as one space; so letters of any script
are told apart with an alphabet of a few hundred symbols.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, piece_of

#: Reference bytes a language, cut evenly from SAMPLE_TEXTS texts or so; of a text over MAX_CHARS characters one piece is
#: sampled.  Over TOTAL / REFERENCE languages share TOTAL bytes, LEAST_REFERENCE each at least.
REFERENCE, SAMPLE_TEXTS, MAX_CHARS, TOTAL, LEAST_REFERENCE = 30_000, 200, 6000, 900_000, 1000
#: Texts are parsed in lanes of LANE bytes, LANES at a time; a phrase ends with its lane.
LANE, LANES = 256, 4096
#: Symbols: 0 is a run of anything but letters, 1 a byte that no reference has, then the references' bytes; the last is padding.
LETTERS_FROM = 2
#: Cells of the tables that are looked up together.
CELLS = 1 << 28


def automaton(codes: list[int], width: int) -> np.ndarray:
    """The suffix automaton of codes as a dense table states x width, -1 where there is no transition; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(nxt), width), -1, np.int32)
    for s, arcs in enumerate(nxt):
        if arcs:
            table[s, list(arcs)] = list(arcs.values())
    return table


@dataclass
class Model:
    """Groups of languages, each with one table for all its automata.

    table[i + c] for the offset i of a state and symbol c: twice the next state's offset, plus 1 if a phrase ended.  roots
    are the offsets of the automata's first states.
    """

    languages: list[str]
    alphabet: bytes
    tables: list[np.ndarray]
    roots: list[np.ndarray]
    bits: np.ndarray


@cache
def folded() -> np.ndarray:
    """code point -> its lower case if that is a letter, else 0; letters are folded one by one."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, lower-case letters alone, runs of others within a text as one 0; bytes and letters by text."""
    points = folded()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    keep = points != 0
    is_letter = np.r_[0, np.cumsum(keep)]
    keep[1:] |= points[:-1] != 0
    starts = np.cumsum(sizes) - sizes
    keep[starts[sizes > 0]] = True
    own = points[keep]
    kept = np.r_[0, np.cumsum(keep)]
    length = np.r_[0, np.cumsum(1 + (own >= 0x80).astype(np.int64) + (own >= 0x800) + (own >= 0x10000))]
    flat = np.frombuffer(own.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
    ends = starts + sizes
    return flat, length[kept[ends]] - length[kept[starts]], is_letter[ends] - is_letter[starts]


def codes_of(alphabet: bytes) -> np.ndarray:
    """byte -> symbol."""
    out = np.ones(256, np.uint8)
    out[0] = 0
    out[list(alphabet)] = np.arange(len(alphabet)) + LETTERS_FROM
    return out


def reference_of(texts: list[str], size: int) -> np.ndarray:
    """About size bytes of the texts: an even share of each, from a place drawn by a fixed seed; what short ones leave is shared."""
    flat, sizes, _ = letters_of(texts)
    starts, rng, left, parts = np.cumsum(sizes) - sizes, np.random.default_rng(0), size, []
    for nth, k in enumerate(np.argsort(sizes, kind="stable")):
        share = min(int(sizes[k]), -(-left // (len(texts) - nth)))
        at = int(starts[k]) + int(rng.integers(0, sizes[k] - share + 1))
        parts += [flat[at : at + share], np.zeros(1, np.uint8)]
        left -= share
    return np.concatenate(parts)


def fit(samples: dict[str, list[str]], reference: int = REFERENCE, total: int = TOTAL) -> Model:
    """Automata of each language's texts."""
    languages = sorted(samples)
    size = min(reference, max(LEAST_REFERENCE, total // max(1, len(languages))))
    own = [reference_of(samples[lang], size) for lang in languages]
    alphabet = bytes(sorted(set(np.unique(np.concatenate(own)).tolist()) - {0})) if own else b""
    lut, width = codes_of(alphabet), len(alphabet) + LETTERS_FROM + 1
    groups, roots, offset = [], [], CELLS
    for x in own:
        raw = automaton(lut[x].tolist(), width)
        if offset + raw.size > CELLS:
            groups.append([])
            roots.append([])
            offset = 0
        # No transition: the phrase ends, and the next one starts with this symbol at the root.
        root = np.where(raw[0] >= 0, raw[0], 0)
        ended = raw < 0
        step = np.where(ended, root[None, :], raw).astype(np.int64) * width + offset
        step = 2 * step + ended
        step[:, -1] = 2 * (np.arange(len(raw), dtype=np.int64) * width + offset)  # padding stays where it is
        groups[-1].append(step.astype(np.int32).ravel())
        roots[-1].append(offset)
        offset += raw.size
    bits = np.array([math.log2(max(2, len(x))) for x in own])
    return Model(languages, alphabet, [np.concatenate(g) for g in groups], [np.array(r, np.int32) for r in roots], bits)


class Parser:
    def __init__(self, model: Model):
        self.m, self.lut = model, codes_of(model.alphabet)
        self.pad = len(model.alphabet) + LETTERS_FROM

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases by language and text, bytes by text, letters by text)."""
        m = self.m
        flat, sizes, n_letters = letters_of(texts)
        flat = self.lut[flat]
        starts = np.cumsum(sizes) - sizes
        lanes = -(-sizes // LANE)
        of = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[of] + nth * LANE
        size = np.minimum(LANE, sizes[of] - nth * LANE)
        out = np.zeros((len(m.languages), len(texts)))
        padded = np.r_[flat, np.zeros(LANE, np.uint8)]
        order = np.argsort(-size, kind="stable")  # full lanes first, so that short ones share blocks
        for at in range(0, len(of), LANES):
            own = order[at : at + LANES]
            width = int(size[own[0]])
            block = padded[begin[own][:, None] + np.arange(width)]
            block[np.arange(width)[None, :] >= size[own][:, None]] = self.pad
            block = np.ascontiguousarray(block.T)
            nth_language = 0
            for table, roots in zip(m.tables, m.roots):
                state = np.repeat(roots[:, None], len(own), 1)
                found = np.zeros(state.shape, np.int32)
                for c in block:
                    v = table[state + c]
                    found += v & 1
                    state = v >> 1
                found += state != roots[:, None]
                for k in range(len(roots)):
                    out[nth_language] += np.bincount(of[own], found[k], len(texts))
                    nth_language += 1
        return out, sizes, n_letters

    def judge(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The language and a score for each text; und and 0 without a letter (or without a language to choose from)."""
        n, langs = len(texts), self.m.languages
        found, sizes, letters = self.phrases(texts) if langs else (np.zeros((1, n)), None, np.zeros(n))
        if not langs:
            return ["und"] * n, np.zeros(n)
        cost = found * self.m.bits[:, None] / np.maximum(sizes, 1)
        best = cost.argmin(0)  # ties: the first language by name
        low = cost.min(0)
        second = np.partition(cost, 1, 0)[1] if len(langs) > 1 else low + 1
        score = np.where(letters > 0, second / np.maximum(low + second, 1e-300), 0.0)
        return [langs[k] if has else "und" for k, has in zip(best, letters > 0)], np.clip(score, 0, 1)


def learn(docs: DataFrame, may_learn: Column, texts_a_language: int = SAMPLE_TEXTS, max_chars: int = MAX_CHARS) -> Model:
    """Fits on about texts_a_language distinct texts of each language, those with the smallest hashes of text.

    A text over max_chars characters is sampled by one piece of max_chars, drawn by its hash; texts whose piece has no
    letter can't be learnt.  Each language that has any text left is learnt, whatever its number of rows or copies.
    """
    text = F.col("text").cast("string")
    own = docs.select(piece_of(text, max_chars, text).alias("text"), F.col("lang").cast("string").alias("lang"), "doc_id")
    own = own.filter(may_learn & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    texts = own.select("lang", F.xxhash64("text").alias("t")).distinct()
    counts = {r["lang"]: r["count"] for r in texts.groupBy("lang").count().collect()}  # the model names them all
    if not counts:
        return fit({})
    bounds = docs.sparkSession.createDataFrame([(k, min(1 << 30, math.ceil(texts_a_language / n * (1 << 30)))) for k, n in counts.items()], "lang string, bound long")
    h = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = own.join(F.broadcast(bounds), "lang").filter(h < F.col("bound")).select("lang", "text").distinct().toPandas()
    samples: dict[str, list[str]] = {}
    for lang, text in sorted(zip(sample["lang"], sample["text"])):
        samples.setdefault(lang, []).append(text)
    return fit(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score from the whole text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(shared.value)
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            langs: list[str] = []
            scores: list[np.ndarray] = []
            at = 0
            while at < len(texts):  # a few million characters at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 2_000_000):
                    size += len(texts[end])
                    end += 1
                k, s = parser.judge(texts[at:end])
                langs += k
                scores.append(s)
                at = end
            yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def languages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; languages are learnt from ids whose crc32 modulo 3 isn't 1.

    und if the text is null or has no letter.  Ties go to the first language by name.  Repeated rows get equal answers.
    """
    held_out = crc_of_id() % 3 == 1
    return predict(docs, learn(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
