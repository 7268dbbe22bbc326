"""Models of both kinds and other normalisers equal the library; settings that aren't compiled are refused by name."""

import math
import random
import struct

import pytest
from sentencepiece import SentencePieceNormalizer, SentencePieceProcessor
from test_operators import odd_texts

from docloom.llm import sentencepiece_fst
from docloom.llm.common import tokenizer_path

PIECES = tokenizer_path("piece_bpe_32k.model")


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def message(field, value):
    """A field that is appended to a model; the last value of a number counts, parts of a message merge."""
    if isinstance(value, int):
        return number(field << 3) + number(value)
    return number(field << 3 | 2) + number(len(value)) + value


def own():
    return SentencePieceProcessor(model_file=PIECES).serialized_model_proto()


@pytest.mark.parametrize(
    "spec, said",
    [(message(2, message(3, 3)), "unigram and BPE"), (message(2, message(35, 0)), "byte fallback"), (message(2, message(24, 1)), "as a suffix"), (message(3, message(5, 0)), "isn't escaped"), (message(1, message(1, b"own") + message(3, 4)), "user-defined")],
)
def test_other_models_are_refused(spec, said):
    assert sentencepiece_fst.unsupported(sentencepiece_fst.fields(own())) == []
    assert any(said in x for x in sentencepiece_fst.unsupported(sentencepiece_fst.fields(own() + spec)))


def test_a_transducer_refuses(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(own() + message(2, message(24, 1)))
    with pytest.raises(ValueError, match="as a suffix"):
        sentencepiece_fst.Transducer(str(path))
    assert sentencepiece_fst.Transducer(PIECES).encode("plain text").size


def nfkc():
    return sentencepiece_fst.fields(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())[3][0]


MAPPED = ["ｱﾞ ＡＢＣ ﬁ x", "\u00a8 a\u0301 ①②  ㍿ \u3000 full　width", " ½ \u00ad x\ufeff ", "\u1100\u1161\u11a8 각", "\t a\u00a0\u00a0 b \n\r c \u200b", "   ", "\u3000", "▁ ▁▁ a ▁", "é\u0323 Å ﷺ"]


def with_scores():
    """The model's bytes with each plain piece's score as of a unigram model, the logarithm of a share that falls with the id."""
    spec, out = sentencepiece_fst.fields(own()), b""
    for i, piece in enumerate(spec[1]):
        kind = sentencepiece_fst.fields(piece).get(3, [1])[-1]
        out += message(1, piece + (number(2 << 3 | 5) + struct.pack("<f", -math.log(i + 7.5)) if kind == 1 else b""))
    return out + b"".join(message(k, b"".join(spec[k])) for k in (2, 3)) + message(2, message(3, 1))


KINDS = {"BPE": own, "unigram": with_scores}
NORMALISERS = {
    "as it is": b"",
    "tidied": message(3, message(4, 1)),
    "without prefix": message(3, message(3, 0)),
    "tidied without prefix": message(3, message(3, 0) + message(4, 1)),
    "NFKC": message(3, nfkc() + message(4, 1)),
    "NFKC, spaces kept": message(3, nfkc() + message(4, 0)),
}


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("normaliser", NORMALISERS)
def test_models_equal_the_library(tmp_path, kind, normaliser):
    path = tmp_path / "some.model"
    path.write_bytes(KINDS[kind]() + NORMALISERS[normaliser])
    library, t = SentencePieceProcessor(model_file=str(path)), sentencepiece_fst.Transducer(str(path))
    rnd = random.Random(5)
    texts = [x for x in odd_texts() if len(x) < 300] + MAPPED + ["".join(rnd.choice(MAPPED)[: rnd.randint(1, 9)] + rnd.choice([" ", "", "  "]) for _ in range(4)) for _ in range(300)]
    wrong = [(x, t.encode(x).tolist(), want) for x, want in zip(texts, library.encode(texts, num_threads=1)) if t.encode(x).tolist() != want]
    if kind == "unigram":  # of two paths of equal sums (b bb and bb b) the library takes one by how its floats are rounded
        cost = lambda ids: sum(library.get_score(i) for i in ids)
        assert len(wrong) <= 3
        wrong = [x for x in wrong if sorted(x[1]) != sorted(x[2]) or abs(cost(x[1]) - cost(x[2])) > 1e-6]
    assert not wrong, (len(wrong), wrong[:3])


def test_unigram_paths_against_brute_force(tmp_path):
    """The least sum over all ways to cut a text into pieces."""
    path = tmp_path / "unigram.model"
    path.write_bytes(with_scores())
    t = sentencepiece_fst.Transducer(str(path))
    rnd = random.Random(2)

    def cuts(x):
        if not x:
            yield 0.0
        for k in range(1, len(x) + 1):
            cost = -t.score[x[:k]] if x[:k] in t.score else t.unknown if k == 1 else None
            if cost is not None:
                yield from (cost + rest for rest in cuts(x[k:]))

    for _ in range(60):
        x = "▁" + "".join(rnd.choice("theingr中🧿") for _ in range(rnd.randint(1, 9)))
        got = t.shortest(x)
        assert "".join(got) == x and abs(sum(-t.score[p] if p in t.score else t.unknown for p in got) - min(cuts(x))) < 1e-6
