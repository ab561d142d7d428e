"""Evaluation metrics over (expected, predicted) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classification_report(df: DataFrame, classes: list[int], slice_by: str) -> DataFrame:
    """By slice and overall (slice ``all``): n, correct, accuracy, macro_f1, undertriage rate, invalid."""
    e, p = F.col("expected"), F.col("predicted")
    rows = df.select(F.explode(F.array(F.lit("all"), F.col(slice_by).cast("string"))).alias("slice"), "expected", "predicted")
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(e == p).alias("correct"), F.count_if((p > e) & (p != 0)).alias("under"), F.count_if(~p.isin(classes)).alias("invalid")]
    for c in classes:
        sums += [F.count_if((e == c) & (p == c)).alias(f"tp{c}"), F.count_if((e != c) & (p == c)).alias(f"fp{c}"), F.count_if((e == c) & (p != c)).alias(f"fn{c}")]
    g = rows.groupBy("slice").agg(*sums)
    f1 = [F.coalesce(F.try_divide(2 * F.col(f"tp{c}"), 2 * F.col(f"tp{c}") + F.col(f"fp{c}") + F.col(f"fn{c}")), F.lit(0.0)) for c in classes]
    macro = sum(f1[1:], f1[0]) / len(classes)
    return g.select("slice", "n", "correct", (F.col("correct") / F.col("n")).alias("accuracy"), macro.alias("macro_f1"), (F.col("under") / F.col("n")).alias("undertriage"), "invalid")


def confusion(df: DataFrame, classes: list[int]) -> DataFrame:
    """Dense matrix: a row for each expected class, a column for each predicted."""
    base = df.sparkSession.createDataFrame([(c,) for c in classes], "expected int")
    cells = df.groupBy(F.col("expected").cast("int").alias("expected")).pivot("predicted", classes).count()
    out = base.join(cells, "expected", "left").na.fill(0)
    return out.select("expected", *[F.col(str(c)).alias(f"predicted_{c}") for c in classes])


def undertriage(df: DataFrame, classes: list[int]) -> DataFrame:
    steps = [(a, b) for a in classes for b in classes if b > a]
    sums = df.agg(*[F.count_if((F.col("expected") == a) & (F.col("predicted") == b)).alias(f"{a}->{b}") for a, b in steps])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f"{a}->{b}").alias("transition"), F.col(f"`{a}->{b}`").alias("n")) for a, b in steps])).alias("r")).select("r.*")


def index_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """mean, p50 (place n // 2), p95 (place int(0.95 n) - 1) and max of the sorted values, by place."""
    w = Window.partitionBy(group)
    d = df.select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("_i"), F.count(F.lit(1)).over(w).alias("_n"))
    last = F.pmod((F.col("_n") * F.lit(95) / 100).cast("long") - 1, F.col("_n"))
    at = lambda i: F.max(F.when(F.col("_i") == i, F.col(value)))
    return d.groupBy(group).agg(F.avg(value).alias("mean"), at(F.floor(F.col("_n") / 2)).alias("p50"), at(last).alias("p95"), F.max(value).alias("max"))


def log_factorial(n: Column) -> Column:
    """ln n!: a sum of logarithms up to 32, Stirling's series beyond."""
    few = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.least(n, F.lit(32)), F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(i.cast("double")))
    x = n.cast("double")
    series = x * F.log(x) - x + F.log(2 * F.pi() * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 32, few).otherwise(series)


def mcnemar(df: DataFrame, right_a: Column, right_b: Column) -> DataFrame:
    """(only_a, only_b, p): the exact two-sided test on discordant pairs.

    The tail is summed from its largest term downwards; 10 standard deviations further on terms are below the last digit.
    """
    n = df.agg(F.count_if(right_a & ~right_b).alias("only_a"), F.count_if(~right_a & right_b).alias("only_b"))
    total, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    top = log_factorial(total) - log_factorial(k) - log_factorial(total - k) - total * F.log(F.lit(2.0))
    far = F.greatest(F.lit(1).cast("long"), k - (5 * F.sqrt(total.cast("double"))).cast("long") - 40)
    below = F.when(k > 0, F.sequence(k, far, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    step = lambda s, i: F.struct((s["sum"] + s["t"] * i.cast("double") / (total - i + 1)).alias("sum"), (s["t"] * i.cast("double") / (total - i + 1)).alias("t"))
    tail = F.aggregate(below, F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("t")), step, lambda s: F.exp(top) * s["sum"])
    return n.select("only_a", "only_b", F.least(F.lit(1.0), 2 * tail).alias("p"))


def preference_accuracy(df: DataFrame, chosen: str, rejected: str, slice_by: str) -> DataFrame:
    """By slice and overall: share of pairs whose chosen score is higher, and the mean margin."""
    rows = df.select(F.explode(F.array(F.lit("all"), F.col(slice_by).cast("string"))).alias("slice"), (F.col(chosen) - F.col(rejected)).alias("margin"))
    return rows.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("margin") > 0).cast("int")).alias("accuracy"), F.avg("margin").alias("mean_margin"))
