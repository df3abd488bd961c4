"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round replaces edges by edges to smaller nodes until every component is a star around its smallest node. A round is
two aggregations with partial sums and two joins; its results are written to the shared folder, which cuts lineage and lets
adaptive execution split the joins on hub nodes. Nothing is collected but the number of edges and a checksum of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Workspace


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(space: Workspace, edges: DataFrame, name: str = "cc", most_rounds: int = 100) -> DataFrame:
    """node, root (the smallest node reachable) for each node that has an edge to another. edges: columns a, b of one type."""
    far = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = space.put(far, f"{name}_0")
    state = _state(now)
    for k in range(1, most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = space.put(_least_neighbour(both), f"{name}_{k}_m1")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        large = space.put(large, f"{name}_{k}_large")
        least = space.put(_least_neighbour(large), f"{name}_{k}_m2")
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.withColumnRenamed("m", "v")).distinct()
        after = space.put(small, f"{name}_{k}")
        for old in (f"{name}_{k - 1}", f"{name}_{k}_m1", f"{name}_{k}_m2", f"{name}_{k}_large"):
            space.drop(old)
        now, before, state = after, state, _state(after)
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("components didn't settle")
