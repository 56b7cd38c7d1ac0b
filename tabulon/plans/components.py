"""Connected components of an edge table: in one task while it is proven small, by alternating stars beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.lineage import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the least of its closed neighbourhood."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the least of them; edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved)


#: Most distinct edges that one task may hold (16 bytes each); the table is counted before.
SMALL_EDGES = 200_000


def _small_components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Components of all edges of the task, by spreading least nodes and halving paths."""
    parts = [f[["a", "b"]].to_numpy() for f in frames if len(f)]
    if not parts:
        return
    nodes, flat = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = flat.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        was = root.copy()
        low = np.minimum(root[a], root[b])
        for side in (a, b, was[a], was[b]):
            np.minimum.at(root, side, low)
        root = root[root]
        if (root == was).all():
            break
    yield pd.DataFrame({"node": nodes, "component": nodes[root]})


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = SMALL_EDGES) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``, whole numbers; component = least node reachable.

    Up to ``small`` distinct edges, counted first, are taken by one task.  Beyond,
    each round is one large-star and one small-star pass (joins and partial
    aggregates only), checkpointed so that the plan stays short and a lost
    executor costs one round.  Self-loops and repeated or reversed edges are
    harmless; nodes without an edge to another node don't appear.
    """
    now = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    if now.count() <= small:
        return cut(now.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInPandas(_small_components, "node long, component long"))
    was = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now).where("a <> b").distinct()).where("a <> b").distinct())
        sign = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sign) == was:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                now.select("b", "b").distinct()
            )
        was = tuple(sign)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
