"""Languages of long texts alone, or of many copies of few texts, are learnt too."""

import random

from llm_fixtures import SCHEMA, prose
from pyspark.sql import functions as F

from docloom.llm import language


def test_long_texts_and_copies_are_learnt(spark):
    rnd = random.Random(3)
    rows = [(i, prose(rnd, 1500), "long", "s", 1) for i in range(4)] + [(10 + i, "zyq wxy qzx " * 20, "copied", "s", 1) for i in range(20_000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert language.learn(docs, F.lit(True)).languages == ["copied", "long"]
    assert language.learn(docs.filter("lang = 'copied'"), F.lit(True), texts_a_language=1).languages == ["copied"]
