import random
import zlib

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [a + b for a in "ba ce di fo gu ha jo ki".split() for b in "lan mer nit pos rux vem".split()]
#: Columns that clash with names the operators use inside, or with their results.
CLASHING = "digest keep_id n k t h p fp m words bucket label score toxic_score slot shard component_id dropped_id text_key held_out count".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and ids, odd characters."""
    rnd = random.Random(11)
    base = prose(rnd, 60)
    texts = [None, "", " \t\n", "word", "two words", base, base, base + " tail", base.upper(), prose(rnd, 20_000), "x" * 100_000, "a" + " " * 500 + "b",
             "naïve café ÄÖÜß 中文 😀 ▁ <|endoftext|>", "\x00\x1f\x85\xa0\u200b", "42 43 44", None, ""]
    rows = [(i, t, ["en", "fr", None][i % 3], None if i % 4 == 0 else f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, base, "en", "src1", len(base))] * 2 + [(None, base, None, None, None), (None, None, None, None, None), (6, "another text for the same id", "fr", None, 3)]
    rows += [(100 + i, prose(rnd, 30), "en", "src0", 1) for i in range(20)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(0, 120)] + [(5, 0, 1), (None, 1, 1), (7, None, None), (9999, 1, 0)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode())
