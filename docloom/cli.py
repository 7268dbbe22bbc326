"""python -m docloom.cli tables ROOT | keys ROOT TABLE | get ROOT TABLE KEY..."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import DocStore, TableNotFound


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if len(args) < 2 or args[0] not in ("tables", "keys", "get") or args[0] != "tables" and len(args) < 3:
        print(__doc__, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("docloom").getOrCreate()
    try:
        store = DocStore.open(spark, args[1])
        if args[0] == "tables":
            print(*store.tables(), sep="\n")
        elif args[0] == "keys":
            for row in store.table(args[2]).keys().toLocalIterator():
                print(row[0])
        else:
            found = store.table(args[2]).get_many(args[3:]).select("_id", F.to_json("doc").alias("json"), "error")
            for row in found.toLocalIterator():
                print(row["json"]) if row["error"] is None else print(row["error"], file=sys.stderr)
    except (FileNotFoundError, TableNotFound) as e:
        print(f"not found: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
