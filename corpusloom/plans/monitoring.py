"""Counters, quantiles and open values of the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import variants
from corpusloom.streaming import counters

from .registry import query, table

BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]
#: A counter of each event type: its place by time, which starts again after 700 events.
COUNTER = "(SELECT event_type, ts, event_id, ((row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) % 700 + 1)::DOUBLE AS value FROM events)"


def _counter(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    place = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return e.select("event_type", "ts", ((place - 1) % 700 + 1).cast("double").alias("value"))


@query(f"""
WITH b AS (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY ts, value) AS before FROM {COUNTER}),
s AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start, CASE WHEN value < before THEN value ELSE value - before END AS step FROM b WHERE before IS NOT NULL)
SELECT event_type, start, sum(step) AS increase, sum(step) / 21600 AS rate FROM s GROUP BY 1, 2""")
def counter_rates(spark, sf_dir):
    return counters.increase(counters.counter_steps(_counter(spark, sf_dir), ["event_type"]), ["event_type"], width="6 hours")


def _quantile_sql(q):
    out = f"{BOUNDS[-1]}"
    for i in reversed(range(len(BOUNDS))):
        low, below = (BOUNDS[i - 1], f"c{i - 1}") if i else (0.0, "0")
        out = f"CASE WHEN c{i} >= {q} * n THEN CASE WHEN c{i} > {below} THEN {low}::DOUBLE + ({BOUNDS[i]} - {low})::DOUBLE * ({q} * n - {below})::DOUBLE / (c{i} - {below}) ELSE {low} END ELSE {out} END"
    return out


@query(f"""
WITH b AS (SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, {', '.join(f'count_if(value <= {b}) AS c{i}' for i, b in enumerate(BOUNDS))}, count(value) AS n FROM events GROUP BY 1, 2)
SELECT event_type, start, ({_quantile_sql(0.95)})::DOUBLE AS p95, ({_quantile_sql(0.5)})::DOUBLE AS p50 FROM b""")
def bucketed_quantiles(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(counters.bucket_counts(F.col("value"), BOUNDS).alias("c"))
    return g.select("event_type", F.col("w.start").alias("start"), counters.histogram_quantile(0.95, F.col("c"), BOUNDS).alias("p95"), counters.histogram_quantile(0.5, F.col("c"), BOUNDS).alias("p50"))


SIDE = "'{\"score\": ' || value || ', \"rank\": ' || event_id % 5 || '}'"
METADATA = f"""CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '{{"chosen": "text", "rejected": ' || {SIDE} || '}}' WHEN 2 THEN '{{"chosen": ' WHEN 3 THEN '[1, ' || event_id || ']' WHEN 4 THEN props WHEN 5 THEN 'plain ' || event_type ELSE '{{"chosen": ' || {SIDE} || ', "rejected": {{"score": null}}}}' END"""


def _metadata(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("metadata", F.expr(METADATA))


@query(f"""
SELECT 'metadata' AS "column", CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN 'object<chosen: string, rejected: object<rank: bigint, score: ' || k || '>>' WHEN 2 THEN 'malformed' WHEN 3 THEN 'array<bigint>' WHEN 4 THEN 'object<k: bigint>' WHEN 5 THEN 'text' ELSE 'object<chosen: object<rank: bigint, score: ' || k || '>, rejected: object<score: void>>' END AS type, count(*) AS n
FROM (SELECT event_id, 'double' AS k FROM events) GROUP BY 1, 2 UNION ALL
SELECT 'value', CASE WHEN value IS NULL THEN 'null' ELSE 'double' END, count(*) FROM events GROUP BY 1, 2""")
def value_type_histogram(spark, sf_dir):
    return variants.type_histogram(_metadata(spark, sf_dir), ["metadata", "value"])


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 6 THEN value END AS chosen_score, CASE WHEN event_id % 7 = 6 THEN event_id % 5 END AS chosen_rank, CASE WHEN event_id % 7 = 1 THEN value END AS rejected_score, CASE WHEN event_id % 7 = 1 THEN event_id % 5 END AS rejected_rank FROM events""")
def preference_metadata(spark, sf_dir):
    return _metadata(spark, sf_dir).select("event_id", variants.preference_sides(F.col("metadata")).alias("s")).select("event_id", "s.*")
