"""Exact nearest neighbours against a small pattern table, by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a pattern table that may be broadcast; the reference size is some dozens.
MOST_PATTERNS = 10_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def similarities(rows: DataFrame, patterns: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows x patterns(pattern_id, kind, pattern_vector) with similarity.

    The pattern table is a fixed query set: its size is checked, and a larger one is refused.  Lengths are taken once a row.
    """
    if patterns.limit(MOST_PATTERNS + 1).count() > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns")
    unit = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    left = rows.withColumn("__n", unit(vector))
    right = patterns.withColumn("__m", unit("pattern_vector"))
    size = F.col("__n") * F.col("__m")
    return left.crossJoin(F.broadcast(right)).withColumn("similarity", F.when(size == 0, F.lit(0.0)).otherwise(dot(F.col(vector), F.col("pattern_vector")) / size)).drop("__n", "__m", "pattern_vector")


def top_k(rows: DataFrame, patterns: DataFrame, k: int, id_column: str, by_kind: bool = True, vector: str = "embedding") -> DataFrame:
    """The k most similar patterns of each row (and kind), ties by pattern id, with their place."""
    found = similarities(rows, patterns, vector).drop(vector)
    keys = [id_column, "kind"] if by_kind else [id_column]
    order = Window.partitionBy(*keys).orderBy(F.desc("similarity"), "pattern_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def margins(rows: DataFrame, patterns: DataFrame, id_column: str, vector: str = "embedding") -> DataFrame:
    """id, best similarity to a scam pattern and to a genuine one, and their difference."""
    found = similarities(rows, patterns, vector)
    best = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("similarity")))
    return found.groupBy(id_column).agg(best("scam").alias("scam"), best("genuine").alias("genuine")).withColumn("margin", F.col("scam") - F.col("genuine"))


def pattern_score(margin: Column, least: float = 0.05, full: float = 0.20) -> Column:
    """60 at the least margin that counts, 100 at the full one."""
    return F.bround(60 + 40 * F.least(F.lit(1.0), (margin - least) / (full - least)), 1)
