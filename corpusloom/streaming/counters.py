"""Counters that may start again at zero, and quantiles from buckets, on tables and streams alike.

A counter's step is its rise since the sample before; where it falls, it was reset, and its new value is the step.  The first
sample of a series has no step.  Quantiles interpolate inside the cumulative bucket that holds the wanted rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UP_TO_ANY = float("inf")


def counter_steps(samples: DataFrame, series: list[str], *, value: str = "value", ts: str = "ts", chunk: str = "day") -> DataFrame:
    """``samples`` (series columns, ts, value) with ``step``, ordered by ts, then value; null values are no samples.

    On a table the order is cut into chunks of time, and a chunk's first sample looks at the last one of the chunk before, so
    that a long series is no single task.  On a stream the last value of a series is state; samples older than it have come too late and are dropped.
    """
    known = samples.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    if samples.isStreaming:
        return _streamed_steps(known, series, value, ts)
    rows = known.withColumn("_chunk", F.date_trunc(chunk, ts))
    last = rows.groupBy(*series, "_chunk").agg(F.max(F.struct(ts, value))[value].alias("_last"))
    ahead = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*series).orderBy("_chunk"))).drop("_last")
    here = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in series]) if series else F.array(F.lit(""))
    key = ["_series", "_chunk"]
    joined = rows.withColumn("_series", here).join(ahead.withColumn("_series", here).select(*key, "_carry"), key, "left")
    before = F.coalesce(F.lag(value).over(Window.partitionBy(*key).orderBy(ts, value)), F.col("_carry"))
    stepped = joined.withColumn("_before", before)
    step = F.when(F.col("_before").isNotNull(), F.when(F.col(value) < F.col("_before"), F.col(value)).otherwise(F.col(value) - F.col("_before")))
    return stepped.withColumn("step", step).drop("_series", "_chunk", "_carry", "_before")


def _streamed_steps(samples: DataFrame, series: list[str], value: str, ts: str) -> DataFrame:
    def steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values([ts, value], kind="stable")
        at, before = state.get if state.exists else (None, None)
        if at is not None:
            rows = rows[rows[ts] >= pd.Timestamp(at)]
        if not len(rows):
            return
        prior = rows[value].shift()
        if before is not None:
            prior.iloc[0] = before
        rows = rows.assign(step=(rows[value] - prior).where(rows[value] >= prior, rows[value]).where(prior.notna()))
        state.update((rows[ts].iloc[-1].to_pydatetime(), float(rows[value].iloc[-1])))
        yield rows

    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in samples.schema], T.StructField("step", T.DoubleType())])
    doubled = samples.withColumn(value, F.col(value).cast("double"))
    out[value].dataType = T.DoubleType()
    return doubled.groupBy(*series).applyInPandasWithState(steps, out, "at timestamp, before double", "append", GroupStateTimeout.NoTimeout)


def increase(steps: DataFrame, group: list[str], *, width: str, slide: str | None = None, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """group, start, increase and rate (a second) of each window over ``counter_steps``; windows without a step are absent."""
    s = steps.withWatermark(ts, late) if steps.isStreaming else steps
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = s.where("step is not null").groupBy(*group, w.alias("w")).agg(F.sum("step").alias("increase"))
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return g.select(*group, F.col("w.start").alias("start"), "increase", (F.col("increase") / seconds).alias("rate"))


def bucket_counts(value: Column, bounds: list[float]) -> Column:
    """An aggregate: of each bound how many values are at most that, and in the end how many there are."""
    return F.array(*[F.count_if(value <= b) for b in bounds], F.count(value))


def histogram_quantile(q: float, counts: Column, bounds: list[float]) -> Column:
    """The q-quantile of cumulative ``counts`` (one a bound, then the total); null without values.

    The first bucket begins at zero, or at its bound if that is not positive; beyond the last bound the last bound is told.
    """
    if not 0 <= q <= 1 or sorted(set(bounds)) != list(bounds) or not bounds:
        raise ValueError("a quantile lies between 0 and 1, bounds rise")
    total = F.get(counts, F.lit(len(bounds)))
    rank = total * F.lit(float(q))
    out = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        upper, count = float(bounds[i]), F.get(counts, F.lit(i))
        lower, below = (float(bounds[i - 1]), F.get(counts, F.lit(i - 1))) if i else (0.0, F.lit(0))
        if not i and upper <= 0:
            inside = F.lit(upper)
        else:
            inside = F.when(count > below, F.lit(lower) + (upper - lower) * (rank - below) / (count - below)).otherwise(F.lit(lower))
        out = F.when(count >= rank, inside).otherwise(out)
    return F.when(total > 0, out)
