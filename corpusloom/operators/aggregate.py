"""Audit aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import is_missing


def group_share(df: DataFrame, group: list[str], within: list[str]) -> DataFrame:
    """Counts by ``group`` and their share of the total of ``within``."""
    n = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def missing_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, missing, rate) in one scan."""
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(is_missing(F.col(c))).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns]))
    return sums.select("_n", rows.alias("r")).select("r.*", F.try_divide("r.missing", "_n").alias("rate"))


def percentile_summary(df: DataFrame, group: list[str], value: Column, points: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated percentiles and the maximum."""
    return df.groupBy(*group).agg(*[F.percentile(value, p).alias(k) for k, p in points.items()], F.max(value).alias("longest"))


def threshold_counts(df: DataFrame, value: Column, thresholds: list[int]) -> DataFrame:
    """(threshold, n_above) in one scan."""
    sums = df.agg(*[F.count_if(value > t).alias(f"t{t}") for t in thresholds])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("n_above")) for t in thresholds])).alias("r")).select("r.*")


def repeat_summary(df: DataFrame, group: list[str], key: Column) -> DataFrame:
    """By group: keys that occur more than once, and their rows."""
    n = df.groupBy(*group, key.alias("_key")).count().where("count > 1")
    return n.groupBy(*group).agg(F.count(F.lit(1)).alias("groups"), F.sum("count").alias("repeated_rows"))


def target_conflicts(df: DataFrame, key: Column, target: str, id_col: str) -> DataFrame:
    """Keys with several targets: (key, n_targets, n_rows, first_id)."""
    g = df.groupBy(key.alias("key")).agg(F.countDistinct(target).alias("n_targets"), F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("first_id"))
    return g.where("n_targets > 1")


def profiles(df: DataFrame, keys: list[str]) -> DataFrame:
    """(profile, value, n): counts of each single key, in one scan by grouping sets."""
    pairs = F.array(*[F.struct(F.lit(k).alias("profile"), F.coalesce(F.col(k).cast("string"), F.lit("<null>")).alias("value")) for k in keys])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.profile", "p.value").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(df: DataFrame, flags: str = "flags") -> DataFrame:
    """(flag, n, n_alone): rows with the flag, and rows with that flag only."""
    alone = F.size(flags) == 1
    return df.select(F.explode(flags).alias("flag"), alone.alias("alone")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if("alone").alias("n_alone"))


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def distribution_distance(df: DataFrame, part: str, value: str) -> DataFrame:
    """(part, distance): L1 distance of each part's distribution of ``value`` to the whole table's."""
    whole = df.groupBy(value).agg(F.count(F.lit(1)).alias("_all"))
    whole = whole.withColumn("_q", F.col("_all") / F.sum("_all").over(Window.partitionBy()))
    own = df.groupBy(part, value).agg(F.count(F.lit(1)).alias("_n"))
    grid = own.select(part).distinct().crossJoin(F.broadcast(whole))  # parts x distinct values, both few
    own = own.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(part))).drop("_n")
    return grid.join(own, [part, value], "left").groupBy(part).agg(F.sum(F.abs(F.coalesce("_p", F.lit(0.0)) - F.col("_q"))).alias("distance"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (manifest): a JSON object with row and column counts of each table."""
    parts = [t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(k).alias("name"), "rows", F.lit(len(t.columns)).alias("columns")) for k, t in tables.items()]
    rows = F.array_sort(F.collect_list(F.struct("name", "rows", "columns")))
    return union_all(parts).agg(F.to_json(F.struct(rows.alias("tables"))).alias("manifest"))


def level_summary(df: DataFrame, by: list[str], score: str, level: str, levels: list[str]) -> DataFrame:
    """n, the mean score and the number of rows at each level, by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean"), *[F.count_if(F.col(level) == x).alias(x) for x in levels])
