"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component), the smallest node reachable, for every node of edges(u, v); nodes without edges are not listed.

    Each step is an aggregation and a join on the node, both with map-side work only proportional to the edges; no neighbourhood is ever collected.
    The number of steps is logarithmic in the number of nodes, and more than ``most`` are an error; the state after each is written to the shared folder.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = written(ends, "edges")
    state = _state(now)
    for _ in range(most):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).union(root.select("u", F.col("m").alias("v")))
        following = written(small.distinct(), "edges")
        after = _state(following)
        dropped(now)
        now = following
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
