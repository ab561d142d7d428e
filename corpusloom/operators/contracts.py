"""Contracts: rules whose violations are counted in one pass, coverage, and joins that must cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule; a rule that is null for a row is broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*[F.col(k) for k in rules]))).alias("rule", "n"))


def partition_by(df: DataFrame, clean: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are clean and all others, null tests among these."""
    ok = F.coalesce(clean, F.lit(False))
    return df.where(ok), df.where(~ok)


def coverage(df: DataFrame, by: list[str], tests: dict[str, Column]) -> DataFrame:
    """n and the share of rows that pass each test, by group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k) for k, c in tests.items()])


def first_choice(df: DataFrame, choices: list[DataFrame], key: str, value: str) -> DataFrame:
    """``df`` with ``value`` from the first of ``choices`` (key, value) that has one; rows without any are dropped."""
    names = []
    for i, c in enumerate(choices):
        names.append(f"_value{i}")
        df = df.join(c.select(key, F.col(value).alias(names[-1])), key, "left")
    return df.withColumn(value, F.coalesce(*names)).where(F.col(value).isNotNull()).drop(*names)


def compare_covered(results: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """One row of agreement between two runs (key, expected, predicted); all null unless the reference covers every result."""
    r, k = results.select(key, "expected", "predicted"), reference.select(key, F.col("expected").alias("ref_expected"), F.col("predicted").alias("ref_predicted"))
    j = r.join(k.withColumn("_there", F.lit(1)), key, "left")
    right, ref_right = F.col("predicted") == F.col("expected"), F.col("ref_predicted") == F.col("ref_expected")
    sums = {
        "rows": F.count(F.lit(1)),
        "same_decision": F.count_if(F.col("predicted") == F.col("ref_predicted")),
        "reference_correct": F.count_if(ref_right),
        "only_result_correct": F.count_if(right & ~(F.col("expected") == F.col("ref_predicted"))),
        "only_reference_correct": F.count_if(ref_right & ~(F.col("ref_expected") == F.col("predicted"))),
    }
    out = j.agg(*[c.alias(n) for n, c in sums.items()], F.count("_there").alias("_covered"))
    return out.select(*[F.when(F.col("_covered") == F.col("rows"), F.col(n)).alias(n) for n in sums])


def weakest_full(df: DataFrame, variant: str, order: list[str], right: Column) -> DataFrame:
    """(variant): the last of ``order`` all of whose rows are right; null where none is."""
    full = df.groupBy(variant).agg(F.bool_and(right).alias("_full"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(variant))
    return full.where("_full").agg(F.max_by(variant, rank).alias(variant))


def apply_rewrites(rows: DataFrame, rewrites: DataFrame, key: str, value: str, text: str) -> DataFrame:
    """``rows`` with ``value`` replaced where a rewrite (key, text) exists and ``original`` kept.

    Fails where a key is rewritten twice or a rewrite meets no row; a null text is no rewrite.
    """
    new = rewrites.select(key, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).groupBy(key).agg(F.min("_text").alias("_text"), F.count(F.lit(1)).alias("_n"))
    twice = F.when(F.col("_n") > 1, F.raise_error(F.lit("a row is rewritten twice")).cast("string"))
    unmet = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a rewrite meets no row")).cast("string"))
    j = rows.withColumn("_there", F.lit(1)).join(new, key, "full")
    j = j.withColumn("_text", F.coalesce(unmet, twice, F.col("_text")))
    return j.withColumn("original", F.when(F.col("_text").isNotNull(), F.col(value))).withColumn(value, F.coalesce("_text", value)).drop("_text", "_n", "_there")
