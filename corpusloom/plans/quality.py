"""Quality gates, privacy and admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed, flags, privacy, records, redaction, text
from corpusloom.functions.fingerprints import record_id, seeded_order

from .registry import query, table

PAIRS = """(SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant')"""


def question_answers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return u.join(a, ["conv_id", "turn"])


K = r"trim(regexp_replace(coalesce(answer, ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))"


@query(rf"""
SELECT conv_id, turn, array_to_string(list_filter([
  CASE WHEN k = '' THEN 'EMPTY_ANSWER' END,
  CASE WHEN k LIKE '%?' AND n < 120 THEN 'QUESTION_AS_ANSWER' END,
  CASE WHEN {" OR ".join(f"starts_with(lower(k), '{o}')" for o in fixed.RESOURCE_OPENINGS)} THEN 'RESOURCE_ONLY_ANSWER' END,
  CASE WHEN lower(k) IN ({", ".join(f"'{w}'" for w in fixed.UNINFORMATIVE)}) THEN 'UNINFORMATIVE_ANSWER' END], lambda x: x IS NOT NULL), ',') AS flags
FROM (SELECT conv_id, turn, {K} AS k, length(regexp_replace(regexp_replace(regexp_replace(coalesce(answer, ''), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')) AS n FROM {PAIRS})""")
def open_answer_flags(spark, sf_dir):
    return question_answers(spark, sf_dir).select("conv_id", "turn", F.array_join(flags.open_answer_flags(F.col("answer")), ",").alias("flags"))


@query(rf"""
SELECT conv_id, turn, length(k) >= 30 AND instr(q, k) > 0 AS leaks FROM (
  SELECT conv_id, turn, {K} AS k, trim(regexp_replace(coalesce(question, ''), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS q FROM {PAIRS})""")
def answer_leakage(spark, sf_dir):
    return question_answers(spark, sf_dir).select("conv_id", "turn", flags.target_leakage(F.col("question"), F.col("answer")).alias("leaks"))


EXTERNAL_SQL = fixed.EXTERNAL_REFERENCE.replace("'", "''")


@query(rf"""
SELECT doc_id, regexp_matches(text, '{fixed.CHAT_TOKEN}') AS chat_token, regexp_matches(text, '{EXTERNAL_SQL}') AS external FROM documents""")
def control_token_flags(spark, sf_dir):
    f = flags.text_flags(F.col("text"))
    has = lambda k: F.array_contains("f", k)
    return table(spark, sf_dir, "documents").select("doc_id", f.alias("f")).select("doc_id", has("CHAT_CONTROL_TOKEN").alias("chat_token"), has("EXTERNAL_REFERENCE").alias("external"))


@query()
def text_anomaly_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(flags.text_flags(F.col("text")), ",").alias("flags"))


@query("""
SELECT conv_id, turn, a = '' OR b = '' AS empty, a <> '' AND a = b AS identical,
  a <> '' AND b <> '' AND greatest(length(question), length(answer)) / greatest(1, least(length(question), length(answer))) > 2 AS biased,
  greatest(length(question), length(answer)) / greatest(1, least(length(question), length(answer))) AS ratio
FROM (SELECT *, """ + K.replace("answer", "question") + " AS a, " + K + f" AS b FROM {PAIRS})")
def preference_flags(spark, sf_dir):
    f = flags.preference_flags(F.col("question"), F.col("answer"))
    q = question_answers(spark, sf_dir).select("conv_id", "turn", f.alias("f"), text.length_ratio(F.col("question"), F.col("answer")).alias("ratio"))
    has = lambda k, n: F.array_contains("f", k).alias(n)
    return q.select("conv_id", "turn", has("EMPTY_DPO_RESPONSE", "empty"), has("IDENTICAL_DPO_RESPONSES", "identical"), has("DPO_LENGTH_BIAS", "biased"), "ratio")


#: Marker dictionaries over folded text: category to terms.
MARKERS = {"ARTICLES": ["the", "les", "der", "los"], "LINKS": ["and", "et", "und", "y"], "NEGATION": ["not", "pas", "nicht", "no"]}
FOLD = r"regexp_replace(lower(strip_accents(replace(replace(text, 'ß', ' '), 'ẞ', ' '))), '[^a-z0-9]+', ' ', 'g')"
MARKER_SQL = ", ".join(f"CASE WHEN regexp_matches(t, ' ({'|'.join(v)}) ') THEN '{k}' END" for k, v in sorted(MARKERS.items()))


@query(rf"""
SELECT lang, category, count(*) AS n FROM (SELECT lang, unnest(list_filter([{MARKER_SQL}], lambda x: x IS NOT NULL)) AS category
  FROM (SELECT lang, ' ' || trim({FOLD}) || ' ' AS t FROM documents)) GROUP BY lang, category""")
def category_marker_counts(spark, sf_dir):
    t = F.concat(F.lit(" "), text.fold_term(F.col("text")), F.lit(" "))
    found = F.array_compact(F.array(*[F.when(t.rlike(f" ({'|'.join(v)}) "), k) for k, v in sorted(MARKERS.items())]))
    return table(spark, sf_dir, "documents").select("lang", F.explode(found).alias("category")).groupBy("lang", "category").agg(F.count(F.lit(1)).alias("n"))


@query(rf"""
WITH m AS (SELECT doc_id, {" + ".join(f"CASE WHEN instr(t, ' {w} ') > 0 THEN 1 ELSE 0 END" for v in MARKERS.values() for w in v)} AS n FROM (SELECT doc_id, ' ' || trim({FOLD}) || ' ' AS t FROM documents))
SELECT CASE WHEN n = 0 THEN 'none' WHEN n <= 2 THEN 'limited' ELSE 'rich' END AS status, count(*) AS n FROM m GROUP BY 1""")
def marker_status(spark, sf_dir):
    t = text.fold_term(F.col("text"))
    n = sum((F.when(text.whole_word(t, F.lit(w)), 1).otherwise(0) for v in MARKERS.values() for w in v), F.lit(0))
    status = F.when(F.col("n") == 0, "none").when(F.col("n") <= 2, "limited").otherwise("rich")
    return table(spark, sf_dir, "documents").select(n.alias("n")).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


PII = [(c, "" if c in fixed.CASED else "(?i)", p) for c, _, p in fixed.RECOGNIZERS if c in ("EMAIL_ADDRESS", "URL", "IP_ADDRESS", "FR_NIR", "PATIENT_ID", "DATE_OF_BIRTH", "IDENTITY_INTRODUCTION", "PHONE_NUMBER")]
PII_SQL = {c: f"len(regexp_extract_all(text, '{mark + '|'.join(f'(?:{x})' for x in p)}'))".replace("['’]", "[''’]").replace("ÿ'’-]", "ÿ''’-]") for c, mark, p in PII}


@query(" UNION ALL ".join(f"SELECT '{c}' AS category, coalesce(sum(n), 0)::BIGINT AS n_matches, count_if(n > 0) AS n_docs FROM (SELECT {x} AS n FROM documents)" for c, x in PII_SQL.items()))
def pii_matches_by_category(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(privacy.matches(F.coalesce("text", F.lit("")))).alias("m")).groupBy("m.category", "doc_id").count()
    found = found.groupBy("category").agg(F.sum("count").alias("n_matches"), F.count(F.lit(1)).alias("n_docs"))
    every = spark.createDataFrame([(c,) for c, *_ in PII], "category string")
    return every.join(found, "category", "left").select("category", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query()
def pii_redacted_once(spark, sf_dir):
    return privacy.redact_once_per_text(table(spark, sf_dir, "documents"))


@query(r"""
SELECT doc_id, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS v,
  CASE WHEN length(v) <= 2 THEN repeat('*', length(v)) ELSE v[1] || repeat('*', length(v) - 2) || v[-1] END AS masked
FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')""")
def masked_previews(spark, sf_dir):
    p = fixed.RECOGNIZERS[0][2][0]
    d = table(spark, sf_dir, "documents").where(F.col("text").rlike(p)).select("doc_id", F.regexp_extract("text", p, 0).alias("v"))
    return d.withColumn("masked", privacy.masked(F.col("v")))


@query(r"""
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'approve' WHEN doc_id % 7 = 1 THEN 'redact' WHEN doc_id % 7 = 2 THEN 'exclude' WHEN doc_id % 7 = 3 THEN 'approve' END AS decision, text, source, doc_id % 7 = 3 AS stale FROM documents),
p AS (SELECT *, CASE WHEN decision IS NULL THEN 'PENDING' WHEN stale THEN 'STALE' WHEN decision = 'approve' THEN 'APPROVED' WHEN decision = 'redact' THEN 'REDACTED' ELSE 'EXCLUDED' END AS privacy FROM d)
SELECT CASE WHEN doc_id % 50 = 0 THEN 'HUMAN_EXCLUDED' WHEN privacy = 'EXCLUDED' THEN 'PRIVACY_EXCLUDED' WHEN privacy IN ('PENDING', 'STALE') THEN 'PRIVACY_FAILED' WHEN source = 'src3' THEN 'SOURCE_BLOCKED'
  WHEN length(text) < 200 THEN 'QUARANTINE' ELSE 'ELIGIBLE' END AS status, privacy, count(*) AS n FROM p GROUP BY 1, 2""")
def admission_statuses(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.sha2("text", 256).alias("content_hash"))
    k = F.col("id") % 7
    made = F.when(k == 0, "approve").when(k == 1, "redact").when(k == 2, "exclude").when(k == 3, "approve")
    decisions = d.select("id", made.alias("decision"), F.when(k == 3, "older").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("zz").alias("target"), F.lit("").alias("replacement")).where("decision is not null")
    p = privacy.apply_decisions(d, decisions).join(d.select("id", "source"), "id")
    open_flags = F.when(F.length("text") < 200, F.array(F.lit("SHORT"))).otherwise(F.array().cast("array<string>"))
    status = flags.admission_status(F.col("id") % 50 == 0, F.col("privacy_status"), flags.unresolved(open_flags), F.col("source") == "src3")
    return p.groupBy(status.alias("status"), F.col("privacy_status").alias("privacy")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
WITH q AS (SELECT doc_id, CASE WHEN length(text) >= 400 THEN 'PASS' WHEN length(text) >= 100 THEN 'REVIEW' ELSE 'FAIL' END AS completeness, CASE WHEN lang = 'en' THEN 'PASS' ELSE 'REVIEW' END AS language FROM documents),
v AS (SELECT q.*, CASE WHEN 'FAIL' IN (completeness, language) THEN 'FAIL' WHEN 'REVIEW' IN (completeness, language) THEN 'REVIEW' ELSE 'PASS' END AS verdict,
  (CASE completeness WHEN 'PASS' THEN 1.0 WHEN 'REVIEW' THEN 0.5 ELSE 0.0 END + CASE language WHEN 'PASS' THEN 1.0 WHEN 'REVIEW' THEN 0.5 ELSE 0.0 END) / 2 AS score FROM q)
SELECT v.doc_id, verdict, score::DOUBLE AS score, coalesce(CASE quality WHEN 1 THEN 'PASS' WHEN 0 THEN 'FAIL' END, verdict) AS final FROM v LEFT JOIN labels ON labels.doc_id = v.doc_id""")
def semantic_verdicts(spark, sf_dir):
    n = F.length("text")
    worst, score = flags.verdict([F.when(n >= 400, "PASS").when(n >= 100, "REVIEW").otherwise("FAIL"), F.when(F.col("lang") == "en", "PASS").otherwise("REVIEW")])
    human = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "PASS").when(F.col("quality") == 0, "FAIL").alias("human"))
    d = table(spark, sf_dir, "documents").select("doc_id", worst.alias("verdict"), score.alias("score")).join(human, "doc_id", "left")
    return d.select("doc_id", "verdict", "score", flags.final_verdict(F.col("verdict"), F.col("human")).alias("final"))


@query("""
WITH q AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A,B' WHEN 2 THEN 'AA' ELSE 'E' END AS raw,
  CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 4 END AS n, p_partkey % 2 = 0 AS multiple, p_partkey % 5 = 0 AS duplicate FROM part),
l AS (SELECT *, CASE WHEN raw IN ('A', 'E') THEN raw WHEN raw = 'A,B' THEN raw END AS labels FROM q)
SELECT p_partkey, labels, NOT (n = 5 OR NOT multiple AND n = 4) OR labels IS NULL OR (labels = 'E' AND n = 4) AS invalid,
  duplicate, CASE WHEN multiple THEN coalesce(labels, '') <> 'A,B' ELSE coalesce(labels, 'A,B') = 'A,B' END AS wrong_mode FROM l""")
def qcm_checks(spark, sf_dir):
    k = F.col("p_partkey")
    fourth = F.when(k % 5 == 0, F.col("p_name")).otherwise(F.concat(F.lit("size "), F.col("p_size").cast("string")))
    raw = F.when(k % 4 == 0, "A").when(k % 4 == 1, "A,B").when(k % 4 == 2, "AA").otherwise("E")
    five = F.when(k % 3 == 0, F.concat(F.lit("key "), k.cast("string")))
    p = table(spark, sf_dir, "part").select("p_partkey", records.choices_map([F.col("p_name"), F.col("p_brand"), F.col("p_type"), fourth, five]).alias("c"), records.parse_labels(raw).alias("l"))
    f = flags.qcm_flags(F.col("c"), F.coalesce("l", F.array().cast("array<string>")), k % 2 == 0)
    has = lambda n, a: F.array_contains(f, n).alias(a)
    return p.select("p_partkey", F.array_join("l", ",").alias("labels"), has("INVALID_QCM", "invalid"), has("DUPLICATE_OPTIONS", "duplicate"), has("INVALID_QCM_MODE", "wrong_mode"))


@query("""SELECT doc_id, substr(sha256(lower(source) || '␟' || doc_id || '␟' || lower(lang)), 1, 24) AS id, sha256('[42,"' || doc_id || '"]') AS draw FROM documents""")
def record_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", record_id(F.col("source"), F.col("doc_id"), F.col("lang")).alias("id"), seeded_order(F.col("doc_id")).alias("draw"))


def _spans_sql(category, mark, patterns):
    """Matches of one category with their places: text between matches and matches add up."""
    p = (mark + "|".join(f"(?:{x})" for x in patterns)).replace("'", "''")
    return f"""SELECT doc_id, '{category}' AS category, list_sum(list_transform(gaps[1:i], lambda g: length(g)))::BIGINT + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0)::BIGINT AS start, hits[i] AS v
  FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS hits, regexp_split_to_array(text, '{p}') AS gaps FROM documents) WHERE len(hits) > 0)"""


@query(f"""SELECT doc_id, category, start, (start + length(v))::BIGINT AS "end", sha256(v) AS value_hash, CASE category {" ".join(f"WHEN '{c}' THEN '{t}'" for c, t, _ in fixed.RECOGNIZERS)} END AS replacement
FROM ({" UNION ALL ".join(_spans_sql(*x) for x in PII)})""")
def redaction_log(spark, sf_dir):
    log = redaction.redaction_log(redaction.scan_texts(table(spark, sf_dir, "documents")))
    return log.select("doc_id", "category", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "value_hash", "replacement")


@query()
def redacted_digests(spark, sf_dir):
    return redaction.redacted_digests(redaction.scan_texts(table(spark, sf_dir, "documents")))
