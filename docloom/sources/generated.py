"""Made-up rows for tests and measurements, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_documents(spark: SparkSession, table: str, n: int, size: int, seed: int = 0) -> DataFrame:
    """(table_name, id, data) as `bulk_load` takes them: ids key_0 to key_<n-1>, a field data of size hex digits each."""
    parts = [F.sha2(F.concat_ws("-", F.lit(seed), "id", F.lit(i)), 256) for i in range(-(-size // 64))]
    body = F.substring(F.concat(*parts), 1, size) if parts else F.lit("")
    return spark.range(n).select(F.lit(table).alias("table_name"), F.concat(F.lit("key_"), "id").alias("id"), F.to_json(F.struct(body.alias("data"))).alias("data"))


def distinct_integers(spark: SparkSession, n: int, below: int, seed: int = 0) -> DataFrame:
    """value: n different integers from 0 to below - 1, all of them if n is larger."""
    return spark.range(below).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n).select(F.col("id").alias("value"))
