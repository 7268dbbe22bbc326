"""Files of JSON lines, plain or compressed by their suffix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value: the lines of files, gzip by suffix; a last line without an end counts, and lines may be of any length."""
    return spark.read.option("lineSep", "\n").text(path)


def count_lines(spark: SparkSession, path: str | list[str]) -> int:
    """Lines, a last one without an end included."""
    return read_lines(spark, path).count()


def read_documents(spark: SparkSession, path: str | list[str], table: str, id_field: str = "_id") -> DataFrame:
    """(table_name, id, data) of the lines that aren't blank, as `bulk_load` takes them; its id is a field of the document.

    Lines that aren't JSON keep their text and have no id, so the load reports them.
    """
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    doc = F.try_parse_json("value")
    return lines.select(F.lit(table).alias("table_name"), F.try_variant_get(doc, f'$["{id_field}"]', "string").alias("id"), F.col("value").alias("data"))
