"""Token counts of a byte-level BPE: whole pre-tokens that are proved to be one token are counted, only the rest is merged."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

#: The split of a byte-level BPE; \s is spelled out, as libraries differ on control characters.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Merged pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 300_000
LIMIT = 1024


def byte_chars() -> list[str]:
    """The character that stands for each byte in the vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(others)) for b in range(256)]


class Counter(dict):
    """pre-token (str) -> number of tokens.

    It starts with the strings proved to encode alone as one token and merges what else it is asked for.  The proof is by
    running the merges on each string of the vocabulary (`proved`), so strings that no order of merges reaches aren't in.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("a byte-level BPE without normaliser or prefix space is needed")
        self.of_byte = byte_chars()
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.of_byte_table = dict(enumerate(self.of_byte))
        self.older: dict[str, int] = {}
        self.library = Tokenizer.from_file(path).model.tokenize  # the same merges, compiled; long pre-tokens use a heap
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        super().__init__(self.proved(model["vocab"]))
        self.whole = len(self)

    def proved(self, vocab: dict[str, int]) -> dict[str, int]:
        to_byte = {c: b for b, c in enumerate(self.of_byte)}
        out = {}
        for symbols in vocab:
            if all(c in to_byte for c in symbols):
                try:
                    text = bytes(to_byte[c] for c in symbols).decode("utf-8")
                except UnicodeDecodeError:  # part of a character; no pre-token is that
                    continue
                if self.merged(list(symbols)) == 1:
                    out[text] = 1
        return out

    def merged(self, parts: list[str | None]) -> int:
        """How many symbols are left when no adjacent pair has a rank; lowest rank first, leftmost of equals.

        By a heap and links: n log n, so a text without a break is no danger.
        """
        n, rank = len(parts), self.rank
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            left -= 1
            for x, y in ((prv[i], i), (i, nxt[i])):
                if x >= 0 and y >= 0 and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return left

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = len(self.library(self._symbols(word))) if len(word) <= 64 else self.merged(list(self._symbols(word)))
        if len(self) >= self.whole + REMEMBERED:
            # The younger half stays reachable in `older`; what is asked for again comes back from there.
            proved = dict.fromkeys(islice(self, self.whole), 1)  # they were put in first
            self.older = dict(islice(self.items(), self.whole, None))
            self.clear()
            self.update(proved)
        if len(word) <= 64:
            self[word] = n
        return n

    def _symbols(self, word: str) -> str:
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.of_byte_table)


def count_tokens(counter: Counter, text: str, split, special) -> int:
    n = 0
    if special is not None and special.search(text):
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(counter.__getitem__, split(p))) for p in parts if p)
    return n + sum(map(counter.__getitem__, split(text)))


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Counts are those of the library that the vocabulary file is for, without begin or end tokens; a special string in a
    text counts as its one token.  Null and empty texts have 0 tokens.  Rows are independent, so repeated rows and ties
    need nothing; memory is bounded by REMEMBERED pre-tokens a worker and one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _loaded(path)
        split = regex.compile(SPLIT).findall
        special = regex.compile("|".join(map(regex.escape, counter.special))) if counter.special else None
        for b in batches:
            texts = b.column(1)
            n = [count_tokens(counter, t.as_py() or "", split, special) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)


_kept: dict[str, Counter] = {}


def _loaded(path: str) -> Counter:
    """The counter of a file, built once a worker and kept over tasks."""
    if path not in _kept:
        _kept.clear()
        _kept[path] = Counter(path)
    return _kept[path]
