"""Cleaning flags, statuses, scores, keys and contracts of curated records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import curation, fingerprints, fixed, flags, privacy, records
from corpusloom.operators import contracts

from .quality import PAIRS, K, question_answers
from .registry import query, table

SQL_TEXT = lambda p: p.replace("'", "''")


@query(rf"""
WITH p AS (SELECT conv_id, turn, question, answer, {K} AS k, coalesce(question, '') AS q, {K.replace("answer", "question")} AS kq FROM {PAIRS}),
f AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'open' ELSE 'dpo' END AS family, *  EXCLUDE (conv_id, turn) FROM p)
SELECT conv_id, turn, family,
  family = 'open' AND k = '' AS empty_answer, q = '' AS empty_question,
  family = 'dpo' AND (k = '' OR kq = '') AS empty_pair, family = 'dpo' AND k <> '' AND k = kq AS identical,
  family = 'dpo' AND k <> '' AND kq <> '' AND greatest(length(question), length(answer)) / greatest(1, least(length(question), length(answer))) > 2 AS biased,
  regexp_matches(q || chr(10) || coalesce(answer, ''), '{fixed.CHAT_TOKEN}') AS chat_token,
  regexp_matches(q || chr(10) || coalesce(answer, ''), '{SQL_TEXT(fixed.EXTERNAL_REFERENCE)}') AS external FROM f""")
def cleaning_flags(spark, sf_dir):
    q, a = F.col("question"), F.col("answer")
    family = F.when(F.col("turn") % 2 == 1, "open").otherwise("dpo")
    none, text = F.array().cast("array<string>"), F.concat_ws("\n", F.coalesce(q, F.lit("")), F.coalesce(a, F.lit("")))
    f = flags.record_flags(family, q, a, F.lit(None).cast("string"), F.create_map().cast("map<string,string>"), none, q, a, F.lit("preference"), none, text)
    rows = question_answers(spark, sf_dir).select("conv_id", "turn", family.alias("family"), f.alias("f"))
    has = lambda k, n: F.array_contains("f", k).alias(n)
    named = {"empty_answer": "EMPTY_ANSWER", "empty_question": "EMPTY_QUESTION", "empty_pair": "EMPTY_DPO_RESPONSE", "identical": "IDENTICAL_DPO_RESPONSES", "biased": "DPO_LENGTH_BIAS", "chat_token": "CHAT_CONTROL_TOKEN", "external": "EXTERNAL_REFERENCE"}
    return rows.select("conv_id", "turn", "family", *[has(k, n) for n, k in named.items()])


LISTED = lambda words: ", ".join(f"'{w}'" for w in words)
OPENS = lambda words: " OR ".join(f"starts_with(k, '{w.strip()}')" for w in words)


@query(rf"""
SELECT conv_id, turn, CASE WHEN k = '' THEN '' ELSE array_to_string(list_filter([
  CASE WHEN {OPENS(fixed.NAVIGATION_OPENINGS)} THEN 'NAVIGATION_ONLY_ANSWER' END, CASE WHEN k LIKE '%?' THEN 'QUESTION_AS_ANSWER' END,
  CASE WHEN {OPENS(fixed.SEMANTIC_RESOURCE_OPENINGS)} THEN 'RESOURCE_ONLY_ANSWER' END, CASE WHEN k IN ({LISTED(fixed.SEMANTIC_UNINFORMATIVE)}) THEN 'UNINFORMATIVE_ANSWER' END,
  CASE WHEN len(string_split(k, ' ')) <= 3 THEN 'VERY_SHORT_OPEN_ANSWER' END], lambda x: x IS NOT NULL), ',') END AS flags
FROM (SELECT conv_id, turn, {K} AS k FROM {PAIRS})""")
def semantic_answer_flags(spark, sf_dir):
    return question_answers(spark, sf_dir).select("conv_id", "turn", F.array_join(flags.semantic_open_flags(F.col("answer")), ",").alias("flags"))


@query(rf"""
SELECT source, coalesce(lang, 'none') AS lang, CASE WHEN r AND doc_id % 2 = 0 THEN 'DEPENDENT_WITH_CONTEXT' WHEN r THEN 'DEPENDENT_WITHOUT_CONTEXT' ELSE 'AUTONOMOUS_OR_UNDETECTED' END AS status, count(*) AS n
FROM (SELECT *, regexp_matches(coalesce(text, ''), '{SQL_TEXT(fixed.CASE_REFERENCE)}') AS r FROM documents) GROUP BY ALL""")
def autonomy_statuses(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    status = curation.autonomy(F.col("text"), F.when(F.col("doc_id") % 2 == 0, "a context"))
    return d.select("source", F.coalesce("lang", F.lit("none")).alias("lang"), status.alias("status")).groupBy("source", "lang", "status").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
SELECT conv_id, turn, regexp_matches(coalesce(answer, ''), '{SQL_TEXT(fixed.REWRITE_FORBIDDEN)}') AS forbidden, k <> '' AND len(string_split(k, ' ')) > 75 AS too_long
FROM (SELECT conv_id, turn, answer, {K} AS k FROM {PAIRS})""")
def rewrite_checks(spark, sf_dir):
    p = curation.rewrite_problems(F.col("answer"))
    return question_answers(spark, sf_dir).select("conv_id", "turn", F.array_contains(p, "FORBIDDEN_WORD").alias("forbidden"), F.array_contains(p, "TOO_LONG").alias("too_long"))


@query("""
WITH q AS (SELECT o_orderkey, o_orderkey % 5 AS p, CASE o_orderkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'several' END AS method,
  CASE WHEN o_orderkey % 7 = 0 THEN [2, 2] WHEN o_orderkey % 11 = 0 THEN [1, 3] ELSE [] END AS c FROM orders),
s AS (SELECT *, CASE WHEN p IN (1, 2, 3) AND method = 'exact' THEN 'strong' WHEN method = 'several' OR len(c) > 0 THEN 'ambiguous' ELSE 'none' END AS status FROM q)
SELECT status, CASE WHEN status = 'strong' THEN 'strong_reference' WHEN c = [2, 2] THEN 'unique_candidate_priority' END AS validation,
  CASE WHEN status = 'strong' THEN p WHEN c = [2, 2] THEN 2 END::INTEGER AS priority, count(*) AS n FROM s GROUP BY ALL""")
def priority_pool(spark, sf_dir):
    k = F.col("o_orderkey")
    p, method = k % 5, F.when(k % 3 == 0, "exact").when(k % 3 == 1, "several")
    c = F.when(k % 7 == 0, F.array(F.lit(2), F.lit(2))).when(k % 11 == 0, F.array(F.lit(1), F.lit(3))).otherwise(F.array().cast("array<int>"))
    status = curation.reference_status(p, method, c, ["exact"], ["several"])
    q = table(spark, sf_dir, "orders").select(status.alias("status"), curation.final_priority(status, p, c).alias("f"))
    return q.groupBy("status", F.col("f.validation").alias("validation"), F.col("f.priority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH q AS (SELECT p_partkey, p_size::DOUBLE AS a, (p_partkey % 10)::DOUBLE AS b, p_retailprice FROM part)
SELECT p_partkey, CASE WHEN a <= 0 AND b <= 0 THEN 'no_match' WHEN greatest(a, b) < 6 THEN 'weak_match' WHEN greatest(a, b) - CASE WHEN least(a, b) > 0 THEN least(a, b) ELSE 0 END < 2 THEN 'ambiguous_match' ELSE 'matched' END AS status,
  CASE WHEN a > 0 AND a >= b THEN 'size' WHEN b > 0 THEN 'key' END AS best, (2 * (p_partkey % 3) + p_partkey % 4 + 3 * (p_partkey % 2) + 2 * (p_partkey % 5))::BIGINT AS score FROM q""")
def rule_match_statuses(spark, sf_dir):
    k = F.col("p_partkey")
    m = F.array(F.struct(F.col("p_size").cast("double").alias("score"), F.lit("a size").alias("rule_id")), F.struct((k % 10).cast("double").alias("score"), F.lit("b key").alias("rule_id")))
    best = F.substring(F.get(curation.best_matches(m), F.lit(0))["rule_id"], 3, 9)
    return table(spark, sf_dir, "part").select("p_partkey", curation.match_status(m, 6.0, 2.0).alias("status"), best.alias("best"), curation.information_score(k % 3, k % 4, k % 2, k % 5).cast("long").alias("score"))


@query("""
WITH q AS (SELECT d.doc_id, d.lang, coalesce(l.quality, 0)::DOUBLE AS quality, CASE d.doc_id % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' WHEN 2 THEN 'FAIL' END AS verdict,
  CASE d.doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.4 END AS confidence, sha256('[42,"' || d.doc_id || '"]') AS draw FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT lang, doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY quality DESC, confidence DESC, CASE verdict WHEN 'PASS' THEN 0 WHEN 'REVIEW' THEN 1 WHEN 'FAIL' THEN 2 ELSE 3 END, draw) AS k FROM q) WHERE k <= 7""")
def quality_ranking(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    verdict = F.when(k % 4 == 0, "PASS").when(k % 4 == 1, "REVIEW").when(k % 4 == 2, "FAIL")
    level = F.when(k % 3 == 0, "high").when(k % 3 == 1, "Medium ").otherwise("low")
    order = curation.quality_order(F.col("quality").cast("double"), curation.routing_confidence(level), verdict, F.array().cast("array<string>"), fingerprints.seeded_order(k))
    return d.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where("k <= 7").select("lang", "doc_id", "k")


@query(rf"""
WITH p AS (SELECT conv_id, turn, {K} AS a, {K.replace("answer", "question")} AS q FROM {PAIRS})
SELECT conv_id, turn, sha256(q) AS input_key, sha256(a) AS target_key FROM p""")
def grouping_keys(spark, sf_dir):
    q, a = F.col("question"), F.col("answer")
    nothing = F.lit(None).cast("string")
    keys = fingerprints.grouping_keys(F.lit("open"), nothing, q, F.lit(None).cast("map<string,string>"), F.array().cast("array<string>"), a, nothing, nothing, records.assemble_input(nothing, q))
    return question_answers(spark, sf_dir).select("conv_id", "turn", keys["input_key"].alias("input_key"), keys["target_key"].alias("target_key"))


@query("""
SELECT unnest(['known_lang', 'short_enough', 'has_label', 'score_in_range']) AS rule,
  unnest([count_if(lang IS NULL), count_if(coalesce(length(text), 0) = 0 OR length(text) >= 20000), count_if(quality IS NULL), count_if(coalesce(quality, -1) NOT BETWEEN 0 AND 1)]) AS n
FROM documents LEFT JOIN labels USING (doc_id)""")
def contract_violations(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    n = F.length("text")
    return contracts.violations(d, {"known_lang": F.col("lang").isNotNull(), "short_enough": (n > 0) & (n < 20000), "has_label": F.col("quality").isNotNull(), "score_in_range": F.col("quality").between(0, 1)})


@query("""
SELECT source, lang, count(*) AS n, avg((quality IS NOT NULL)::INTEGER) AS labelled, avg(coalesce(length(text) > 500, false)::INTEGER) AS long_text FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang""")
def extraction_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return contracts.coverage(d, ["source", "lang"], {"labelled": F.col("quality").isNotNull(), "long_text": F.length("text") > 500})


@query("""
WITH s AS (SELECT doc_id, 'strong' AS v FROM documents WHERE doc_id % 3 = 0), r AS (SELECT doc_id, 'recovered' AS v FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, coalesce(s.v, r.v) AS value FROM documents LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id) WHERE coalesce(s.v, r.v) IS NOT NULL""")
def reference_or_recovery(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    one = lambda m, v: d.where(F.col("doc_id") % m == 0).withColumn("value", F.lit(v))
    return contracts.first_choice(d, [one(3, "strong"), one(2, "recovered")], "doc_id", "value")


COVERED = "(SELECT o_orderkey AS id, o_orderkey % 3 AS expected, (o_orderkey + CASE WHEN o_orderkey % {} = 0 THEN 1 ELSE 0 END) % 3 AS predicted FROM orders)"


@query(f"""
SELECT count(*) AS rows, count_if(a.predicted = b.predicted) AS same_decision, count_if(b.predicted = b.expected) AS reference_correct,
  count_if(a.predicted = a.expected AND b.predicted <> a.expected) AS only_result_correct, count_if(b.predicted = b.expected AND a.predicted <> b.expected) AS only_reference_correct
FROM {COVERED.format(5)} a JOIN {COVERED.format(7)} b USING (id)""")
def covered_comparison(spark, sf_dir):
    k = F.col("o_orderkey")
    run = lambda m: table(spark, sf_dir, "orders").select(k.alias("id"), (k % 3).alias("expected"), ((k + F.when(k % m == 0, 1).otherwise(0)) % 3).alias("predicted"))
    return contracts.compare_covered(run(5), run(7), "id")


@query("SELECT conv_id, turn, 'question' AS field, question AS text FROM " + PAIRS + " WHERE trim(regexp_replace(coalesce(question, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> '' UNION ALL SELECT conv_id, turn, 'answer', answer FROM " + PAIRS + " WHERE trim(regexp_replace(coalesce(answer, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) <> ''")
def record_fields(spark, sf_dir):
    items = records.field_texts({"question": F.col("question"), "answer": F.col("answer")})
    return question_answers(spark, sf_dir).select("conv_id", "turn", F.inline(items))


@query("SELECT count(*) AS n, 0 AS n_residual FROM documents")
def residual_privacy(spark, sf_dir):
    left = F.size(privacy.residual(F.col("redacted")))
    d = table(spark, sf_dir, "documents").select(privacy.redact(F.coalesce("text", F.lit(""))).alias("redacted"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(left > 0).alias("n_residual"))


@query("""SELECT conv_id, count(*) AS n, list_sort(list(DISTINCT lower(role))) AS roles FROM conversations GROUP BY conv_id""")
def unique_roles(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")).alias("role"))
    g = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.collect_list("role").alias("roles"))
    return g.select("conv_id", "n", F.array_sort(F.transform(records.unique_texts(F.col("roles")), F.lower)).alias("roles"))
