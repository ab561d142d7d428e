"""Audit reports over documents, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import flags, text
from corpusloom.functions.fingerprints import text_digest
from corpusloom.operators import aggregate, window

from .registry import query, table

KEY = r"trim(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"""
WITH k AS (SELECT lang, doc_id, sha256({KEY}) AS h, {KEY} AS t FROM documents),
s AS (SELECT lang, CASE WHEN t = '' THEN 'QUARANTINE' WHEN doc_id <> min(doc_id) OVER (PARTITION BY h) THEN 'DUPLICATE' ELSE 'ELIGIBLE' END AS status FROM k)
SELECT lang, status, count(*) AS n FROM s GROUP BY lang, status""")
def admission_by_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", "doc_id", text_digest(F.col("text")).alias("h"), text.key_text(F.col("text")).alias("t"))
    d = window.duplicate_of(d, "h", "doc_id")
    status = F.when(F.col("t") == "", "QUARANTINE").when(F.col("duplicate_of").isNotNull(), "DUPLICATE").otherwise("ELIGIBLE")
    return d.groupBy("lang", status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, source, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM documents GROUP BY lang, source")
def group_count_share(spark, sf_dir):
    return aggregate.group_share(table(spark, sf_dir, "documents"), ["lang", "source"], ["lang"])


@query("""
WITH r AS (SELECT count(*) AS n, """ + ", ".join(f"count_if({c} IS NULL OR lower(trim({c}::VARCHAR)) IN ('', 'nan', 'none', 'null')) AS {c}" for c in ("doc_id", "text", "lang", "source", "n_chars")) + """ FROM documents)
SELECT column_name, missing, missing / n AS rate FROM (UNPIVOT r ON doc_id, text, lang, source, n_chars INTO NAME column_name VALUE missing)""")
def missing_value_audit(spark, sf_dir):
    return aggregate.missing_audit(table(spark, sf_dir, "documents"), ["doc_id", "text", "lang", "source", "n_chars"])


@query("SELECT lang, quantile_cont(n, 0.5) AS median, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS longest FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY lang")
def length_percentiles(spark, sf_dir):
    return aggregate.percentile_summary(table(spark, sf_dir, "documents"), ["lang"], F.length("text"), {"median": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT t AS threshold, (SELECT count(*) FROM documents WHERE length(text) > t) AS n_above FROM (VALUES (512), (1024), (2048)) v(t)")
def length_thresholds(spark, sf_dir):
    return aggregate.threshold_counts(table(spark, sf_dir, "documents"), F.length("text"), [512, 1024, 2048])


@query("SELECT source, count(n) AS n, avg(n) AS mean, stddev_samp(n) AS std, min(n) AS low, quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.5) AS q2, quantile_cont(n, 0.75) AS q3, max(n) AS high FROM (SELECT source, length(text) AS n FROM documents) GROUP BY source")
def describe_lengths(spark, sf_dir):
    n = F.length("text")
    q = [F.percentile(n, p).alias(k) for k, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))]
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(n).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("low"), *q, F.max(n).alias("high"))


@query("SELECT lang, count_if(source = 'src0') AS src0, count_if(source = 'src1') AS src1, count_if(source = 'src2') AS src2 FROM documents GROUP BY lang")
def lang_source_pivot(spark, sf_dir):
    return aggregate.pivot_counts(table(spark, sf_dir, "documents"), "lang", "source", ["src0", "src1", "src2"])


@query(rf"""
SELECT lang, count(*) AS groups, sum(n)::BIGINT AS repeated_rows FROM (SELECT lang, {KEY} AS k, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY lang""")
def repeat_summary(spark, sf_dir):
    return aggregate.repeat_summary(table(spark, sf_dir, "documents"), ["lang"], text.key_text(F.col("text")))


@query(rf"""
SELECT sha256({KEY}) AS key, count(DISTINCT quality) AS n_targets, count(*) AS n_rows, min(doc_id) AS first_id
FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(DISTINCT quality) > 1""")
def conflicting_targets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return aggregate.target_conflicts(d, text_digest(F.col("text")), "quality", "doc_id")


@query("""
SELECT 'lang' AS profile, coalesce(lang, '<null>') AS value, count(*) AS n FROM documents GROUP BY 2
UNION ALL SELECT 'source', coalesce(source, '<null>'), count(*) FROM documents GROUP BY 2""")
def value_profiles(spark, sf_dir):
    return aggregate.profiles(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT quality, count_if(toxic = 0) AS toxic_0, count_if(toxic = 1) AS toxic_1 FROM labels GROUP BY quality")
def quality_crosstab(spark, sf_dir):
    return aggregate.pivot_counts(table(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]).select("quality", F.col("0").alias("toxic_0"), F.col("1").alias("toxic_1"))


@query("""
WITH k AS (SELECT unnest(json_keys(props)) AS key FROM events)
SELECT key, count(*) AS n, count(*) / (SELECT count(*) FROM events) AS coverage FROM k GROUP BY key""")
def json_key_coverage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = e.agg(F.count(F.lit(1)).alias("_n"))
    keys = e.select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return keys.crossJoin(F.broadcast(n)).select("key", "n", (F.col("n") / F.col("_n")).alias("coverage"))  # one row of counts


@query("""
WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id)
SELECT count(*) AS distinct_ids, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS repeated_rows FROM g""")
def repeated_ids(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy("user_id").count()
    return g.agg(F.count(F.lit(1)).alias("distinct_ids"), F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("repeated_rows"))


@query("""
WITH w AS (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL)
SELECT lang, word, n, 100.0 * n / sum(n) OVER (PARTITION BY lang) AS percent FROM c""")
def word_percent_by_lang(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.explode(F.split(F.lower(F.col("text")), " ")).alias("word")).where("word <> ''")
    return aggregate.group_share(w, ["lang", "word"], ["lang"]).select("lang", "word", "n", (100 * F.col("share")).alias("percent"))


@query("""
WITH p AS (SELECT doc_id % 3 AS part, lang FROM documents), w AS (SELECT lang, count(*) / sum(count(*)) OVER () AS q FROM p GROUP BY lang),
o AS (SELECT part, lang, count(*) / sum(count(*)) OVER (PARTITION BY part) AS r FROM p GROUP BY part, lang)
SELECT x.part, sum(abs(coalesce(o.r, 0) - w.q)) AS distance FROM (SELECT DISTINCT part FROM p) x CROSS JOIN w LEFT JOIN o ON o.part = x.part AND o.lang = w.lang GROUP BY x.part""")
def split_balance(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("part"), "lang")
    return aggregate.distribution_distance(d, "part", "lang")


@query("SELECT 'x' AS flag, 1 AS n, 1 AS n_alone WHERE false UNION ALL " + r"""
SELECT flag, count(*) AS n, count_if(len(fs) = 1) AS n_alone FROM (
  SELECT fs, unnest(fs) AS flag FROM (SELECT list_filter([
    CASE WHEN trim(t) = '' THEN 'EMPTY_TEXT' END, CASE WHEN regexp_matches(t, '[ ]{3,}') THEN 'EXCESSIVE_SPACES' END,
    CASE WHEN length(t) > 0 AND length(regexp_replace(t, '[A-Za-z0-9 \t\n\x0B\f\r\x{0080}-\x{FFFF}]', '', 'g')) / length(t) > 0.3 THEN 'HIGH_SYMBOL_RATIO' END,
    CASE WHEN trim(t) <> '' AND length(trim(t)) < 20 THEN 'VERY_SHORT_TEXT' END], lambda x: x IS NOT NULL) AS fs FROM (SELECT coalesce(text, '') AS t FROM documents))) GROUP BY flag""")
def audit_flag_counts(spark, sf_dir):
    return aggregate.flag_counts(table(spark, sf_dir, "documents").select(flags.audit_flags(F.col("text")).alias("flags")))


@query()
def manifest_rollup(spark, sf_dir):
    return aggregate.manifest({n: table(spark, sf_dir, n) for n in ("documents", "labels", "pages", "conversations")})
