"""Ranking and representatives inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def first_per_group(df: DataFrame, keys: list[Column], order: list[Column], n) -> DataFrame:
    """The first ``n`` rows (a number or a column) of each group in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def duplicate_of(df: DataFrame, group: str, key: str) -> DataFrame:
    """Adds duplicate_of: the smallest key of the group, null for that row itself."""
    first = F.min(key).over(Window.partitionBy(group))
    return df.withColumn("duplicate_of", F.when(F.col(key) != first, first))


def best_margin(df: DataFrame, key: str, candidate: str, score: str) -> DataFrame:
    """(key, best, best_score, margin): the best candidate and its lead over the second."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc(candidate))
    d = df.withColumns({"_k": F.row_number().over(w), "_next": F.lead(score, 1, 0.0).over(w)}).where("_k = 1")
    return d.select(key, F.col(candidate).alias("best"), F.col(score).alias("best_score"), (F.col(score) - F.col("_next")).alias("margin"))


def look_ahead_pairs(df: DataFrame, block: list[str], order: list[str], key: str, reach: int = 5) -> DataFrame:
    """(left, right): each row with the next ``reach`` rows of its block."""
    w = Window.partitionBy(*block).orderBy(*order)
    ahead = F.array_compact(F.array(*[F.lead(key, k).over(w) for k in range(1, reach + 1)]))
    return df.withColumn("_ahead", ahead).select(F.col(key).alias("left"), F.explode("_ahead").alias("right"))
