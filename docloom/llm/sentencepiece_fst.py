"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The transducer is compiled from a model file: its normaliser (character map, dummy prefix, extra white space), a trie of the
pieces, and byte fallback arcs for characters that no piece holds.  A text's encoding is the shortest path through the
composition, in the tropical semiring: weights along a path add up, the least sum wins.  For a unigram model a piece weighs
the negative of its score.  For a BPE model the weights are on pairs of adjacent pieces: 0 if merging the two pieces' characters
gives just these two, infinite otherwise; a sequence of pieces is what the merges give exactly if each adjacent pair is such
a pair, so the shortest path is the only finite one.  No piece joins a letter to a following U+2581, so a text falls into
units (white space and the word behind it) that are composed one by one and remembered.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

SPACE = "▁"
#: Units that a worker remembers before it starts afresh.
REMEMBERED = 300_000
PAIRS = 500_000
#: Texts whose ids are held at a time.
ROWS = 1000
INF = float("inf")


def fields(message: bytes) -> dict[int, list]:
    """A protobuf message's values by field number: integers, or bytes."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (message[at] & 127) << shift
            if message[at] < 128:
                return out, at + 1
            at, shift = at + 1, shift + 7

    out: dict[int, list] = {}
    at = 0
    while at < len(message):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = message[at : at + size], at + size
        out.setdefault(key >> 3, []).append(value)
    return out


UNIGRAM, BPE = 1, 2
#: What an unknown character costs beyond the dearest piece in a unigram model.
UNKNOWN = 10.0


def unsupported(spec: dict[int, list]) -> list[str]:
    """What a model (by field number) asks for that the transducer doesn't do."""
    trainer, normaliser = (_merged(spec, k) for k in (2, 3))
    wrong = {
        "a model type other than unigram and BPE": _last(trainer, 3, UNIGRAM) not in (UNIGRAM, BPE),
        "no byte fallback": not _last(trainer, 35, 0),
        "white space as a suffix": bool(_last(trainer, 24, 0)),
        "white space that isn't escaped": not _last(normaliser, 5, 1),
        "user-defined pieces": any(_last(fields(p), 3, 1) == 4 for p in spec.get(1, [])),
    }
    return [k for k, v in wrong.items() if v]


def _merged(spec: dict[int, list], k: int) -> dict[int, list]:
    return fields(b"".join(spec.get(k, [])))


def _last(message: dict[int, list], k: int, default):
    return message.get(k, [default])[-1]


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a precompiled character map: a double array over bytes whose values are places in a block of texts."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    out: dict[str, str] = {}
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    letters = np.arange(1, 256)
    stack = [(offset(int(units[0])), b"")]
    while stack:
        node, prefix = stack.pop()
        at = node ^ letters
        inside = at < len(units)
        for c in letters[inside][(units[at[inside]] & 0x800000FF) == letters[inside]].tolist():
            unit = int(units[node ^ c])
            after, own = (node ^ c) ^ offset(unit), prefix + bytes([c])
            if unit >> 8 & 1:
                place = int(units[after]) & 0x7FFFFFFF
                out[own.decode("utf-8", "surrogatepass")] = texts[place : texts.index(0, place)].decode("utf-8")
            stack.append((after, own))
    return out


class Normaliser:
    """A model's normaliser, compiled: the longest rule at each place is applied, then white space is treated."""

    def __init__(self, spec: dict[int, list]):
        self.rules = character_map(_last(spec, 2, b""))
        self.prefix, self.tidy = bool(_last(spec, 3, 1)), bool(_last(spec, 4, 1))
        self.trie: dict = {}
        for source, target in self.rules.items():
            at = self.trie
            for c in source:
                at = at.setdefault(c, {})
            at[None] = target
        self.starts = re.compile("[" + "".join(map(re.escape, self.trie)) + "]") if self.trie else None

    def mapped(self, text: str) -> str:
        m = self.starts.search(text) if self.starts else None
        if not m:
            return text
        out, at = [], 0
        while m:
            start = m.start()
            node, k, found, end = self.trie, start, None, start
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if None in node:
                    found, end = node[None], k
            out.append(text[at:start])
            out.append(text[start] if found is None else found)
            at = start + 1 if found is None else end
            m = self.starts.search(text, at)
        return "".join([*out, text[at:]])

    def apply(self, text: str) -> str:
        """White space becomes U+2581; tidied, runs of it count once and those at the ends not at all."""
        if not text:
            return ""
        text = self.mapped(text)
        if self.tidy:
            text = re.sub(" +", " ", text).strip(" ")
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return text.rstrip(SPACE) if self.tidy else text


class Transducer:
    """Composes texts with the pieces of one model; `encode` and `decode` are inverse up to the normaliser."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        spec = fields(model.serialized_model_proto())
        if wrong := unsupported(spec):
            raise ValueError(f"{path}: the transducer doesn't support {', '.join(wrong)}")
        self.by_merges = _last(_merged(spec, 2), 3, UNIGRAM) == BPE
        self.normaliser = Normaliser(_merged(spec, 3))
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: model.get_score(i) for i in plain}
        self.unknown = UNKNOWN - min(self.score.values(), default=0.0)
        self.byte_id = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.strip(SPACE) or (p.endswith(SPACE) and p.strip(SPACE)) for p in self.id_of):
            raise ValueError("a piece holds white space behind a letter; units aren't independent")
        self.longest = max(map(len, self.id_of))
        self.trie = self._compiled()
        self.unit = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spines: dict[str, tuple] = {}
        self.blank_front = ""
        self.pairs: dict[tuple[str, str], bool] = {}
        self.bytes_of = [b""] * n
        for p, i in self.id_of.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_id):
            self.bytes_of[i] = bytes([b])

    def _compiled(self) -> dict:
        """The trie: character -> (node, piece or None); its arcs are the input side of the piece transducer."""
        root: dict = {}
        for p in self.id_of:
            at = root
            for c in p[:-1]:
                at = at.setdefault(c, [{}, None])[0]
            at.setdefault(p[-1], [{}, None])[1] = p
        stack = [root]
        while stack:  # tuples are unpacked faster
            at = stack.pop()
            for c, (node, piece) in at.items():
                at[c] = (node, piece)
                stack.append(node)
        return root

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: best score first, leftmost of equals.  Used at compile time and on short runs."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = -INF, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (s > best or at < 0):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spines(self, piece: str) -> tuple[tuple, tuple]:
        """((part, made at, used up at) along the right edge), (the same along the left edge), outermost first.

        Times are negated scores; a character is there from the start, the piece itself is never used up.
        """
        known = self.spines.get(piece)
        if known is None:
            sides = []
            for side in (1, 0):
                part, gone, out = piece, INF, []
                while True:
                    halves = self.halves(part)
                    made = -self.score[part] if halves else -INF
                    out.append((part, made, gone))
                    if not halves:
                        break
                    part, gone = halves[side], made
                sides.append(tuple(out))
            known = self.spines[piece] = tuple(sides)
        return known

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge joined; None for a character."""
        if len(piece) == 1:
            return None
        parts, score = list(piece), self.score
        while len(parts) > 2:
            best = max(range(len(parts) - 1), key=lambda i: (score.get(parts[i] + parts[i + 1], -INF), -i))
            if parts[best] + parts[best + 1] not in score:
                raise KeyError(piece)
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts[0], parts[1]

    def weight(self, a: str, b: str) -> float:
        """The tropical weight of piece b behind piece a: infinite if some merge across their border comes first.

        A part x at the right edge of a and a part y at the left edge of b merge if x + y is a piece that comes before
        either is used up, and both are there at one time; of equal scores the merge further left comes first.
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = True
            score = self.score
            for y, y_made, y_gone in self._spines(b)[1]:
                for x, x_made, x_gone in self._spines(a)[0]:
                    s = score.get(x + y)
                    if s is not None and -s < x_gone and -s <= y_gone and x_made < y_gone and y_made < x_gone:
                        known = False
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[a, b] = known
        return 0.0 if known else INF

    def arcs(self, text: str, at: int) -> list[str]:
        """The pieces that text has at a place, shortest first; where no piece is the character alone, the byte fallback for it."""
        node, out = self.trie, []
        for c in text[at : at + self.longest]:
            found = node.get(c)
            if found is None:
                break
            node, piece = found
            if piece is not None:
                out.append(piece)
        if not out or len(out[0]) > 1:
            out.insert(0, text[at])
        return out

    def shortest(self, text: str) -> list[str]:
        """The pieces on the shortest path through the composition of text with the transducer."""
        return self._by_pairs(text) if self.by_merges else self._by_sums(text)

    def _by_sums(self, text: str) -> list[str]:
        """Least sum first (Dijkstra): what a path costs behind a place doesn't depend on its pieces, so a place is settled once.

        Of equal sums the path whose last piece is longer wins, as in the library (which adds in single precision over the
        whole text, so there rounding can decide between equal sums).
        """
        heap: list[tuple] = [(0.0, 0, 0, "")]
        came: dict[int, str] = {}
        while heap:
            cost, start, at, p = heappop(heap)
            if at in came:
                continue
            came[at] = p
            if at == len(text):
                break
            for q in self.arcs(text, at):
                if at + len(q) not in came:
                    heappush(heap, (cost - self.score[q] if q in self.score else cost + self.unknown, at, at + len(q), q))
        out, at = [], len(text)
        while at:
            out.append(came[at])
            at -= len(came[at])
        return out[::-1]

    def _by_pairs(self, text: str) -> list[str]:
        """The least sum where all weights are 0 or infinite, so the first path to the end is shortest: arcs longest first.

        A prefix's own encoding is unique, so there is one finite state a place and a place is entered once.
        """
        n, longest, trie, pairs = len(text), self.longest, self.trie, self.pairs
        path: list[str] = []
        stack: list[list[str]] = []
        at, a, entered = 0, "", set()
        while at < n:
            node, arcs = trie, []
            for c in text[at : at + longest]:
                found = node.get(c)
                if found is None:
                    break
                node, p = found
                if p is not None:
                    arcs.append(p)
            if not arcs or len(arcs[0]) > 1:
                arcs.insert(0, text[at])
            stack.append(arcs)
            while True:
                arcs = stack[-1]
                while arcs:
                    p = arcs.pop()
                    if at + len(p) not in entered:
                        ok = not a or pairs.get((a, p))
                        if ok or (ok is None and self.weight(a, p) == 0.0):
                            break
                else:
                    stack.pop()
                    if not path:
                        raise AssertionError(f"no path through {text!r}")
                    at -= len(path.pop())
                    a = path[-1] if path else ""
                    continue
                break
            path.append(p)
            at += len(p)
            entered.add(at)
            a = p
        return path

    def ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id_of.get(p)
            if i is None:
                out += [self.byte_id[b] for b in p.encode("utf-8", "surrogatepass")]
            else:
                out.append(i)
        return out

    def blank(self, k: int) -> list[str]:
        """The pieces of k times U+2581 in a BPE model, which its merges decide by place: all such pieces have one score.

        The first piece depends on a few of the next ones at most, so a long run is taken from its front.
        """
        out = []
        while k > 4 * self.longest:
            if not self.blank_front:
                self.blank_front = self.merged(SPACE * 4 * self.longest)[0]
            out.append(self.blank_front)
            k -= len(self.blank_front)
        return out + self.merged(SPACE * k)

    def compose(self, unit: str) -> bytes:
        """The ids of one unit as 32-bit integers."""
        old = self.older.get(unit)
        if old is not None:
            self._remember(unit, old)
            return old
        word = unit.lstrip(SPACE)
        k = len(unit) - len(word)
        if not self.by_merges:
            pieces = self.shortest(unit)
        elif not word:
            pieces = self.blank(k)
        elif k < 2:
            pieces = self.shortest(unit)
        else:
            pieces = self.shortest(SPACE + word)
            pieces = self.blank(k) + pieces[1:] if pieces[0] == SPACE else self.blank(k - 1) + pieces
        out = array("i", self.ids(pieces)).tobytes()
        if len(unit) <= 64:
            self._remember(unit, out)
        return out

    def _remember(self, unit: str, ids: bytes) -> None:
        if len(self.memo) >= REMEMBERED:
            self.older, self.memo = self.memo, {}
        self.memo[unit] = ids

    def encode(self, text: str) -> np.ndarray:
        memo = self.memo
        out = []
        for u in self.unit.findall(self.normaliser.apply(text)):
            ids = memo.get(u)
            out.append(self.compose(u) if ids is None else ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the inverse transducer, less the dummy prefix.  Bytes that aren't UTF-8 become U+FFFD."""
        out = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return out[1:] if self.normaliser.prefix else out


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, token_ids, decoded_crc32, round_trip.

    Ids are those of the library, without begin and end tokens.  token_ids is decoded again; decoded_crc32 is the crc32 of
    that text in UTF-8, round_trip whether it is the input (a literal U+2581 comes back as a space, so it is false for
    texts with one, and for texts that the model's normaliser changes).  Null and empty texts have no tokens and come back empty.  Rows are
    independent; a task holds one batch of texts, the ids of ROWS and at most twice REMEMBERED units and PAIRS pairs, and
    leaves none of them in its worker.
    """
    from zlib import crc32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer(path)  # some 0.2 s a task; a kept one would fill its worker while other operators run there
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids, crcs, same = [], [], []
            for x in b.column(1):
                text = x.as_py() or ""
                own = t.encode(text)
                back = t.decode(own.tolist()) if len(own) else ""
                ids.append(own)
                crcs.append(crc32(back.encode("utf-8", "surrogatepass")))
                same.append(back == text)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), lists, pa.array(crcs, pa.int64()), pa.array(same)], names=["doc_id", "n_tokens", "token_ids", "decoded_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id {kind}, n_tokens bigint, token_ids array<int>, decoded_crc32 bigint, round_trip boolean")
