"""Connected components over an edge table, without gathering edges or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Edges of a task, about.
TASK_EDGES = 200_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; root is the smallest node of the component.

    Alternating large and small stars (Kiveris et al., "Connected Components in MapReduce and Beyond"): every step is one
    pre-aggregated minimum for each node and one join, which adaptive execution splits where a hub has most of the edges.
    Each round is cut with ``checkpoint()``. Steps run in as many tasks as the edges fill, not in the session's number of
    partitions: most rounds have few edges, and hundreds of empty tasks would each leave files. Self-loops and null ends are
    ignored; no edges give no rows.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _signature(e)
    while before[0]:
        tasks = -(-before[0] // TASK_EDGES)
        filled = lambda df: df.coalesce(tasks)  # noqa: B023, E731
        e = filled(e)
        lowest = e.select(F.col("v").alias("node"), F.col("v").alias("m")).unionByName(e.select(F.col("u").alias("node"), F.col("v").alias("m")))
        lowest = filled(filled(lowest).groupBy("node").agg(F.min("m").alias("m")))
        large = filled(filled(e.join(lowest, e["v"] == lowest["node"]).select("u", F.col("m").alias("v"))).distinct())
        least = filled(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = filled(large.join(least, "u"))
        small = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(filled(filled(small.unionByName(least.select("u", F.col("m").alias("v")))).distinct()))
        after = _signature(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
