"""Constraint checks: each returns (check, violations); a sound table has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import union_all


def _named(name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")


def unique(df: DataFrame, key: str, name: str) -> DataFrame:
    return _named(name, df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()))


def known(df: DataFrame, reference: DataFrame, key: str, name: str) -> DataFrame:
    return _named(name, df.where(F.col(key).isNotNull()).join(reference.select(key).distinct(), key, "left_anti"))


def never(df: DataFrame, bad: Column, name: str) -> DataFrame:
    return _named(name, df.where(bad))


def same_lineage(left: DataFrame, right: DataFrame, key: str, column: str, name: str) -> DataFrame:
    r = right.select(key, F.col(column).alias("_other"))
    return _named(name, left.join(r, key).where(~F.col(column).eqNullSafe(F.col("_other"))))


def report(checks: list[DataFrame]) -> DataFrame:
    return union_all(checks)


def schema_difference(left: DataFrame, right: DataFrame) -> list[tuple[str, str]]:
    """(column, what): columns that one side lacks, or that differ in type."""
    a, b = (dict(d.dtypes) for d in (left, right))
    return sorted((c, "left only" if c not in b else "right only" if c not in a else f"{a[c]} <> {b[c]}") for c in {*a, *b} if a.get(c) != b.get(c))
