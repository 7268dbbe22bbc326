"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bit_slices import linked_roots
from .common import discard, lean, lookup, written

#: Up to so many edges (16 MB of them) are joined in one task.
FEW_EDGES = 1_000_000


def components(edges: DataFrame, most_rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """node, root for every node of edges (a, b); root is the smallest node of its component.

    Large-star and small-star in turn: each step links a node's neighbours straight to its smallest one, so a chain of n
    nodes needs about log2(n) rounds.  Every step is a groupBy with partial aggregation and a lookup that bears nodes of
    many neighbours; its result is written to the shared folder, so lost executors cost one step.  The driver sees two
    numbers a round.  No more than `few` edges are joined by one task instead.  Self-loops and repeated edges are dropped; an
    edge table without rows gives no nodes.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc-edges")
    n = now.count()
    if n <= few:
        return now.coalesce(1).mapInPandas(lean(_joined), "node bigint, root bigint")
    before = None
    for _ in range(most_rounds):
        large = _linked(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), 2 * n)
        large = written(large.filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "cc-edges")
        small = _linked(large, large.count())
        step = small.select("u", F.col("m").alias("v")).unionByName(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        after = written(step.filter("u <> v").distinct(), "cc-edges")
        discard(now)
        discard(large)
        now = after
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError(f"components: no end after {most_rounds} rounds")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(edges: DataFrame, n: int) -> DataFrame:
    """edges (u, v) with m, the smallest neighbour of u; n is how many edges there are."""
    return lookup(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "u", "n", n).drop("n")


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdf = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=np.int64), *batches], ignore_index=True)
    nodes, at = np.unique(pdf[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    at = at.reshape(-1, 2)
    root = linked_roots(len(nodes), iter([(at[:, 0], at[:, 1])]))  # nodes are sorted: the smallest index is the smallest node
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})
