"""What workers keep when an operator has run there: it adds to what the operators behind it need."""

import os
import re
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import sentencepiece_fst
from docloom.llm.common import tokenizer_path

ROLLUP = Path("/proc/self/smaps_rollup")


def workers(spark):
    """By process id, a worker's own MB."""

    def run(batches):
        for _ in batches:
            time.sleep(0.3)  # so that all workers get a task
            mb = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", ROLLUP.read_text()))) // 1024
            yield pa.RecordBatch.from_arrays([pa.array([os.getpid()]), pa.array([mb])], names=["pid", "mb"])

    rows = spark.range(0, 16, 1, 16).mapInArrow(run, "pid bigint, mb bigint").collect()
    return {r["pid"]: r["mb"] for r in rows}


@pytest.mark.skipif(not ROLLUP.exists(), reason="memory can't be read here")
def test_workers_give_memory_back(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.substring(F.hex(F.xxhash64("id", k)), 1, 8))
    docs = spark.range(0, 8000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    before = workers(spark)
    sentencepiece_fst.encode_documents(docs, tokenizer_path("piece_bpe_32k.model")).write.format("noop").mode("overwrite").save()
    after = workers(spark)
    grown = [after[p] - before[p] for p in after if p in before]
    assert grown and max(grown) < 40, (before, after)
