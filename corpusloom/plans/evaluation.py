"""Evaluation metrics and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import metrics
from corpusloom.streaming import sliding_rates

from .audit import KEY
from .registry import query, table

RESULTS = "(SELECT o_orderkey AS id, o_orderstatus AS slice, o_orderkey % 3 + 1 AS expected, CASE WHEN o_custkey % 11 = 0 THEN 0 WHEN o_custkey % 4 = 0 THEN o_custkey % 3 + 1 ELSE o_orderkey % 3 + 1 END AS predicted, o_totalprice FROM orders)"


def results(spark, sf_dir):
    e = F.col("o_orderkey") % 3 + 1
    p = F.when(F.col("o_custkey") % 11 == 0, 0).when(F.col("o_custkey") % 4 == 0, F.col("o_custkey") % 3 + 1).otherwise(e)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("slice"), e.alias("expected"), p.alias("predicted"), "o_totalprice")


F1 = " + ".join(f"coalesce(2.0 * count_if(expected = {c} AND predicted = {c}) / nullif(2 * count_if(expected = {c} AND predicted = {c}) + count_if(expected <> {c} AND predicted = {c}) + count_if(expected = {c} AND predicted <> {c}), 0), 0)" for c in (1, 2, 3))


@query(f"""
SELECT s AS slice, count(*) AS n, count_if(expected = predicted) AS correct, count_if(expected = predicted) / count(*) AS accuracy, ({F1}) / 3 AS macro_f1,
  count_if(predicted > expected AND predicted <> 0) / count(*) AS undertriage, count_if(predicted NOT IN (1, 2, 3)) AS invalid
FROM (SELECT *, unnest(['all', slice]) AS s FROM {RESULTS}) GROUP BY s""")
def classification_report(spark, sf_dir):
    return metrics.classification_report(results(spark, sf_dir), [1, 2, 3], "slice")


@query(f"SELECT expected::INTEGER AS expected, {', '.join(f'count_if(predicted = {c}) AS predicted_{c}' for c in (1, 2, 3))} FROM {RESULTS} GROUP BY expected")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(results(spark, sf_dir), [1, 2, 3])


@query(f"SELECT '1->2' AS transition, count_if(expected = 1 AND predicted = 2) AS n FROM {RESULTS} UNION ALL SELECT '1->3', count_if(expected = 1 AND predicted = 3) FROM {RESULTS} UNION ALL SELECT '2->3', count_if(expected = 2 AND predicted = 3) FROM {RESULTS}")
def undertriage_transitions(spark, sf_dir):
    return metrics.undertriage(results(spark, sf_dir), [1, 2, 3])


@query("""
WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, avg(value) AS mean, max(value) AS top, count(*) AS n FROM events GROUP BY event_type)
SELECT event_type, mean, v[n // 2 + 1] AS p50, v[((n * 95 // 100 - 1 + n) % n) + 1] AS p95, top AS max FROM s""")
def latency_percentiles(spark, sf_dir):
    return metrics.index_percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query(f"""
WITH n AS (SELECT count_if(expected = predicted AND id % 7 = 0) AS only_a, count_if(expected <> predicted AND id % 7 <> 0) AS only_b FROM {RESULTS})
SELECT only_a, only_b, least(1.0, 2 * (SELECT sum(exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))) FROM range(0, least(only_a, only_b)::BIGINT + 1) t(i))) AS p FROM n""")
def mcnemar(spark, sf_dir):
    r = results(spark, sf_dir)
    return metrics.mcnemar(r, F.col("expected") == F.col("predicted"), F.col("id") % 7 != 0)


@query(f"""
SELECT s AS slice, count(*) AS n, avg(CASE WHEN m > 0 THEN 1 ELSE 0 END) AS accuracy, avg(m) AS mean_margin FROM (SELECT unnest(['all', slice]) AS s, o_totalprice - expected * 50000.0 AS m FROM {RESULTS}) GROUP BY s""")
def preference_accuracy(spark, sf_dir):
    r = results(spark, sf_dir).withColumn("bar", F.col("expected") * 50000.0)
    return metrics.preference_accuracy(r, "o_totalprice", "bar", "slice")


@query(rf"""
SELECT lang, count(*) AS n, count(DISTINCT {KEY}) / count(*) AS unique_rate, avg(len(string_split({KEY}, ' '))) AS mean_words, avg(regexp_matches(text, '[0-9]')::INTEGER) AS digit_rate FROM documents GROUP BY lang""")
def explanation_rates(spark, sf_dir):
    t = text.key_text(F.col("text"))
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(t) / F.count(F.lit(1))).alias("unique_rate"), F.avg(F.size(F.split(t, " "))).alias("mean_words"), F.avg(F.col("text").rlike("[0-9]").cast("int")).alias("digit_rate"))


@query()
def generation_checks(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    u = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    j = d.join(u, ["conv_id", "turn"])
    return j.select("conv_id", "turn", text.has_repeated_sentence(F.col("text")).alias("repeats"), text.sentence_count(F.col("text")).alias("sentences"), text.grounding(F.col("text"), F.col("context")).alias("grounding"))


@query(f"SELECT slice AS variant, count(*) AS n, count_if(expected = predicted) AS correct, count_if(predicted > expected AND predicted <> 0) AS undertriaged, quantile_cont(o_totalprice, 0.5) AS median FROM {RESULTS} GROUP BY slice")
def variant_summary(spark, sf_dir):
    e, p = F.col("expected"), F.col("predicted")
    return results(spark, sf_dir).groupBy(F.col("slice").alias("variant")).agg(F.count(F.lit(1)).alias("n"), F.count_if(e == p).alias("correct"), F.count_if((p > e) & (p != 0)).alias("undertriaged"), F.percentile("o_totalprice", 0.5).alias("median"))


@query(r"""
WITH s AS (SELECT event_type, value, unnest(generate_series(0, 3)) AS k, ts FROM events),
w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - k * INTERVAL '15 minutes' AS start, event_type, value FROM s)
SELECT start, event_type, count(*) AS n, avg(value) AS mean_value FROM w GROUP BY start, event_type""")
def events_sliding_rate(spark, sf_dir):
    return sliding_rates(table(spark, sf_dir, "events"), width="1 hour", step="15 minutes")
