"""Semantic quality and medical categories of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import categories, fixed_categories
from corpusloom.operators import semantic

from .quality import PAIRS, K, question_answers
from .registry import query, table

KEY = lambda c: K.replace("answer", c)
LEAK = lambda t, s: f"(length({t}) >= 30 AND instr({s}, {t}) > 0)"
OPEN_FLAGS = "(n <= 3 OR k LIKE '%?')"


@query(rf"""
WITH r AS (SELECT conv_id, turn, ['open', 'dpo', 'mcqu'][conv_id % 3 + 1] AS family, answer,
    question || CASE WHEN conv_id % 13 = 0 THEN ' ' || answer WHEN conv_id % 13 = 1 THEN ' the answer is b' ELSE '' END AS question,
    CASE WHEN conv_id % 5 = 0 THEN answer ELSE 'Non. ' || question END AS rejected,
    CASE conv_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['C'] WHEN 2 THEN ['A'] ELSE ['B'] END AS labels FROM {PAIRS}),
k AS (SELECT *, {KEY("answer")} AS k, {KEY("question")} AS q, {KEY("rejected")} AS x, len(string_split({KEY("answer")}, ' ')) AS n,
    CASE WHEN conv_id % 7 = 0 THEN '' ELSE {KEY("question")} END AS i FROM r),
d AS (SELECT conv_id, turn, family,
  CASE family WHEN 'dpo' THEN CASE WHEN q = '' OR k = '' OR x = '' THEN 'FAIL' ELSE 'PASS' END WHEN 'open' THEN CASE WHEN i = '' OR k = '' THEN 'FAIL' ELSE 'PASS' END ELSE CASE WHEN i = '' THEN 'FAIL' ELSE 'PASS' END END AS completeness,
  CASE family WHEN 'open' THEN CASE WHEN k = '' THEN 'FAIL' WHEN {OPEN_FLAGS} THEN 'REVIEW' ELSE 'PASS' END
    WHEN 'mcqu' THEN CASE WHEN len(labels) = 0 OR labels[1] = 'C' THEN 'FAIL' WHEN labels[1] = 'A' AND k = '' OR labels[1] = 'B' AND q = '' THEN 'FAIL' ELSE 'PASS' END END AS alignment,
  CASE WHEN conv_id % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END AS language_quality, CASE WHEN conv_id % 9 = 0 THEN 'REVIEW' ELSE 'PASS' END AS autonomy, CASE WHEN conv_id % 9 = 1 THEN 'REVIEW' ELSE 'PASS' END AS text_quality,
  CASE WHEN family = 'dpo' AND ({LEAK("k", "q")} OR {LEAK("x", "q")}) OR family = 'open' AND {LEAK("k", "q")} OR family = 'mcqu' AND conv_id % 4 = 3 AND conv_id % 13 = 1 THEN 'REVIEW' ELSE 'PASS' END AS target_leakage,
  CASE WHEN family = 'dpo' THEN CASE WHEN k <> '' AND k = x OR conv_id % 9 = 4 THEN 'FAIL' ELSE 'PASS' END END AS preference_consistency FROM k),
v AS (SELECT *, [completeness, language_quality, autonomy, text_quality, target_leakage, coalesce(alignment, preference_consistency)] AS a FROM d)
SELECT * EXCLUDE (a), CASE WHEN list_contains(a, 'FAIL') THEN 'FAIL' WHEN list_contains(a, 'REVIEW') THEN 'REVIEW' ELSE 'PASS' END AS verdict,
  round((len(list_filter(a, lambda y: y = 'PASS')) + len(list_filter(a, lambda y: y = 'REVIEW')) / 2) / 6, 4) AS quality_score FROM v""")
def semantic_quality(spark, sf_dir):
    c, q, a = F.col("conv_id"), F.col("question"), F.col("answer")
    none = F.array().cast("array<string>")
    one = lambda x: F.array(F.lit(x))
    family = F.element_at(F.array(F.lit("open"), F.lit("dpo"), F.lit("mcqu")), (c % 3 + 1).cast("int"))
    told = F.when(c % 13 == 0, F.concat(q, F.lit(" "), a)).when(c % 13 == 1, F.concat(q, F.lit(" the answer is b"))).otherwise(q)
    r = question_answers(spark, sf_dir).select(
        "conv_id", "turn", "answer", family.alias("family"), told.alias("question"), a.alias("chosen"),
        F.when(c % 5 == 0, a).otherwise(F.concat(F.lit("Non. "), q)).alias("rejected"),
        F.when(c % 7 == 0, "").otherwise(told).alias("input"), F.lit(None).cast("string").alias("context"),
        F.when(c % 3 == 2, F.create_map(F.lit("A"), a, F.lit("B"), told)).alias("choices"),
        F.when(c % 4 == 0, none).when(c % 4 == 1, one("C")).when(c % 4 == 2, one("A")).otherwise(one("B")).alias("labels"),
        F.lit("fr").alias("language"), F.when(c % 4 == 0, "en").when(c % 4 == 1, "FR ").alias("detected_language"),
        F.when(c % 9 == 0, one("NEEDS_CONTEXT")).when(c % 9 == 1, one("TEXT_ANOMALY")).when(c % 9 == 4, one("DPO_INVERSION")).otherwise(none).alias("flags"),
    )
    dims = ["completeness", "alignment", "language_quality", "autonomy", "text_quality", "target_leakage", "preference_consistency"]
    return semantic.assess(r).select("conv_id", "turn", "family", *dims, "verdict", "quality_score")


#: Told at the end of each document, so that categories of every kind are met.
TOLD = [
    "", "Patient en détresse respiratoire, SpO2 basse, coma.", "Severe chest pain and fever, blood pressure low after a fall.", "Suspicion d’AVC; hémorragie massive.",
    "Overdose of alcohol, depression, suicidal.", "Infarctus du myocarde, urgence.", "Pregnancy and HIV; genetic mutation.", "Nouveau-né: convulsions depuis 3 heures.",
    "Painting the pulsed shocking stroked dispatch.", "L’infection, le cancer, la dose-response.", "Leukemia with metastases; opioids; self-harm.",
]
PHRASE = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TOLD) + f"][doc_id % {len(TOLD)} + 1]"
#: Letters beyond ASCII count as letters at the edges of words.
FOLDED = rf"regexp_replace(regexp_replace(strip_accents(lower(coalesce(text, '') || ' ' || {PHRASE})), '[ \t\n\x0B\f\r]+', ' ', 'g'), '[^\x00-\x7F\P{{L}}]', 'z', 'g')"
MET = lambda markers: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, '{'|'.join(p)}') THEN '{k}' END" for k, p in markers.items()) + "], lambda x: x IS NOT NULL)"
TERMS = ", ".join(f"'{w}'" for w in fixed_categories.MEDICAL_TERMS)


@query(rf"""
WITH f AS (SELECT doc_id, {FOLDED} AS t FROM documents),
m AS (SELECT doc_id, {MET(fixed_categories.TRIAGE)} AS triage, {MET(fixed_categories.RISK)} AS risk, {MET(fixed_categories.SENSITIVE_HEALTH)} AS sensitive,
  len(list_filter(list_distinct(regexp_extract_all(t, '\w(?:[\w''-]*\w)?')), lambda w: w IN ({TERMS}))) AS n FROM f)
SELECT doc_id, array_to_string(triage, ',') AS triage_categories, array_to_string(risk, ',') AS risk_categories, array_to_string(sensitive, ',') AS sensitive_health_categories, n AS medical_marker_count,
  CASE WHEN n = 0 THEN 'NO_MARKER_DETECTED' WHEN n <= 2 THEN 'MEDICAL_MARKERS_PRESENT' ELSE 'MEDICAL_MARKERS_STRONG' END AS medical_status,
  CASE WHEN len(triage) >= 3 THEN 'TRIAGE_MARKERS_STRONG' WHEN len(triage) >= 1 THEN 'TRIAGE_MARKERS_PRESENT' ELSE 'NO_TRIAGE_MARKER_DETECTED' END AS triage_status, len(risk) > 0 AS risk_flag FROM m""")
def medical_details(spark, sf_dir):
    told = F.element_at(F.array(*map(F.lit, TOLD)), (F.col("doc_id") % len(TOLD) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), told).alias("text"))
    d = categories.with_medical_details(d, "text")
    joined = {f"{k}_categories": F.array_join(f"{k}_categories", ",") for k in ("triage", "risk", "sensitive_health")}
    return d.withColumns(joined).drop("text", "triage_marker_count")
