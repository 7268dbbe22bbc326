"""A folder of JSON lines as a stream into a store: each micro-batch is one bulk load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.files import Conflict
from ..operators.store import DocStore


def stream_lines_into(store: DocStore, folder: str, table: str, checkpoint: str, id_field: str = "_id", files_a_batch: int = 100, most_loads: int = 32) -> StreamingQuery:
    """Starts a query that loads new files of folder, insert-if-absent, and ends when all present ones are in.

    A batch that is run again after a failure finds its ids stored and adds nothing, so each row is stored once.  When the
    table consists of more than most_loads loads they are compacted, so neither folders nor the catalog grow for ever.
    """
    lines = store.spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder)

    def load(batch: DataFrame, _: int) -> None:
        doc = F.try_parse_json("value")
        rows = batch.filter(F.trim("value") != "").select(
            F.lit(table).alias("table_name"), F.try_variant_get(doc, f'$["{id_field}"]', "string").alias("id"), F.col("value").alias("data")
        )
        store.bulk_load(rows)
        if store.load_count(table) > most_loads:
            try:
                store.compact(table, most_loads=most_loads)
            except Conflict:  # another writer changed the table meanwhile: a later batch tries again
                pass

    return lines.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
