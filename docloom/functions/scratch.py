"""A folder for stores that live as long as a query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder that the session names in spark.checkpoint.dir.

    Without it, a session whose executors are threads of the driver gets a temporary folder; any other is refused, for its
    executors would each write to a folder of their own machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="docloom-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
