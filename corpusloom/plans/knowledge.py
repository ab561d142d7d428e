"""Knowledge extraction, record gates, rewrites and summaries of curated records."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fingerprints, knowledge
from corpusloom.functions.fixed_knowledge import ANATOMY, INTENTS, SUBJECTS
from corpusloom.operators import aggregate, contracts

from .quality import PAIRS, question_answers
from .registry import query, table

QUOTED = lambda p: p.replace("'", "''")

ASKED = [
    "What are the symptoms of {}?", "what is (are) {} ?", "How can {} be treated ?", "Quels sont les traitements du {} ?", "Do you have information about {}", "Who is at risk for {}??",
    "Is {} inherited?", "Comment prévenir {} ?", "Tell me of {}.", "What is {}", "How common is {}?", "Qu'est-ce que {}?",
]
WIDGET = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '" + QUOTED(t).replace("{}", "' || p_name || '") + "'" for i, t in enumerate(ASKED)) + " END"


@query(f"""
SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(q, '{QUOTED(p)}', 'i') THEN '{n}'" for n, p in INTENTS)} END AS intent,
  coalesce({", ".join(f"nullif(trim(regexp_extract(q, '{QUOTED(p)}', 1, 'i')), '')" for p in SUBJECTS)}) AS subject
FROM (SELECT p_partkey, {WIDGET} AS q FROM part)""")
def question_subjects(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    asked = F.get(F.array(*[F.lit(t) for t in ASKED]), (F.col("p_partkey") % 12).cast("int"))
    q = F.replace(asked, F.lit("{}"), F.col("p_name"))
    return p.select("p_partkey", knowledge.question_intent(q).alias("intent"), knowledge.question_subject(q).alias("subject"))


SAID = [" The HEART and lungs, skinny.", " Le Cœur; les poumons (moelle épinière)", "", " colon-abdomen eyes"]
WHOLE_WORDS = {lang: "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches(t, '(?:^|[^\p{{L}}\p{{N}}_]){w}(?:$|[^\p{{L}}\p{{N}}_])', 'i') THEN '{w}' END" for w in sorted(words)) + "], lambda x: x IS NOT NULL)" for lang, words in ANATOMY.items()}


@query(f"""
SELECT doc_id, CASE lang {" ".join(f"WHEN '{k}' THEN array_to_string({v}, ',')" for k, v in WHOLE_WORDS.items())} ELSE '' END AS terms
FROM (SELECT doc_id, lang, coalesce(text, '') || CASE doc_id % 4 {" ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SAID))} END AS t FROM documents)""")
def anatomy_mentions(spark, sf_dir):
    said = F.get(F.array(*[F.lit(s) for s in SAID]), (F.col("doc_id") % 4).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), said)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(knowledge.anatomy(text, F.col("lang")), ",").alias("terms"))


@query("""
WITH q AS (SELECT p_partkey, [p_name, p_brand, p_type, NULL, upper(p_name)] AS v, CASE p_partkey % 4 WHEN 0 THEN ['A', 'C'] WHEN 1 THEN ['B'] WHEN 2 THEN ['E', 'A', 'D'] ELSE [] END AS labels, CASE p_partkey % 3 WHEN 0 THEN 'other' WHEN 1 THEN p_brand END AS direct FROM part),
a AS (SELECT *, list_transform(labels, lambda l: v[ascii(l) - 64]) AS found FROM q)
SELECT p_partkey, array_to_string(labels, ',') AS labels,
  CASE WHEN p_partkey % 4 = 2 THEN upper(v[1]) || CASE WHEN direct IS NULL THEN '' ELSE '|' || direct END
       ELSE array_to_string(list_filter(list_append(found, CASE WHEN list_contains(found, direct) THEN NULL ELSE direct END), lambda x: x IS NOT NULL), '|') END AS answers,
  array_to_string(list_filter(['A', 'B', 'C', 'E'], lambda l: NOT list_contains(labels, l)), ',') AS wrong
FROM a""")
def answer_knowledge(spark, sf_dir):
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    choices = F.map_from_arrays(F.array(*[F.lit(x) for x in ("a", "B", "C ", "D", "E")]), F.array("p_name", "p_brand", "p_type", none, F.upper("p_name")))
    labels = knowledge.correct_labels(F.when(k % 4 == 0, "A, c").when(k % 4 == 1, "B/F;bb").when(k % 4 == 2, "e|A|D A"))
    direct = F.when(k % 3 == 0, "other").when(k % 3 == 1, "b")
    row = table(spark, sf_dir, "part").select(k, labels.alias("l"), choices.alias("c"), direct.alias("d"))
    answers, wrong = knowledge.correct_answers(F.col("c"), F.col("l"), F.col("d")), knowledge.distractors(F.col("c"), F.col("l"))
    return row.select(k, F.array_join("l", ",").alias("labels"), F.array_join(answers, "|").alias("answers"), F.array_join(wrong["label"], ",").alias("wrong"))


@query("""
SELECT conv_id, turn, 'a case' || chr(10) || conv_id || CASE WHEN turn % 4 = 0 THEN '' ELSE chr(10) || chr(10) || 'Which one is it' || chr(10) || 'Is it so?' END AS narrative FROM """ + PAIRS)
def case_narratives(spark, sf_dir):
    asked = F.concat(F.lit("Context: a case\n"), F.col("conv_id").cast("string"), F.lit("\n\nWhich one is it\nIs it so?"), F.when(F.col("turn") % 4 == 0, "\n A. x\nB) y").otherwise("\n"))
    return question_answers(spark, sf_dir).select("conv_id", "turn", knowledge.clinical_narrative(asked).alias("narrative"))


@query(r"""
SELECT conv_id, turn, regexp_replace(coalesce(answer, ''), '^\s+|\s+$', '', 'g') AS explanation, sha256(to_json({'answer': answer, 'context': NULL::VARCHAR, 'language': 'en', 'question': question})) AS fingerprint FROM """ + PAIRS)
def request_fingerprints(spark, sf_dir):
    a = F.col("answer")
    told = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("PRIORITY: P1\nEXPLANATION:\n "), F.coalesce(a, F.lit("")))).otherwise(a)
    digest = fingerprints.json_digest({"question": F.col("question"), "answer": a, "language": F.lit("en"), "context": F.lit(None).cast("string")})
    return question_answers(spark, sf_dir).select("conv_id", "turn", knowledge.case_explanation(told).alias("explanation"), digest.alias("fingerprint"))


@query("""
WITH e AS (SELECT event_type, event_id % 7 = 0 AS x, CASE event_id % 5 WHEN 0 THEN 'SCHEMA_UNSUPPORTED' WHEN 1 THEN 'PII_REDACTION_FAILED' WHEN 2 THEN 'HIGH_RISK' END AS f FROM events)
SELECT event_type, count(*) AS n, count_if(NOT x AND f IS DISTINCT FROM 'SCHEMA_UNSUPPORTED') AS n_duplicate, count_if(NOT x AND (f IS NULL OR f = 'HIGH_RISK')) AS n_conflict FROM e GROUP BY event_type""")
def candidate_gates(spark, sf_dir):
    k = F.col("event_id")
    f = F.when(k % 5 == 0, F.array(F.lit("SCHEMA_UNSUPPORTED"))).when(k % 5 == 1, F.array(F.lit("PII_REDACTION_FAILED"))).when(k % 5 == 2, F.array(F.lit("HIGH_RISK")))
    gates = {"n_duplicate": knowledge.may_repeat(k % 7 == 0, f), "n_conflict": knowledge.may_conflict(k % 7 == 0, f)}
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(n) for n, c in gates.items()])


@query("""
WITH q AS (SELECT p_partkey % 3 AS p, p_partkey % 2 AS k, p_partkey % 5 AS m, p_partkey % 7 < 3 AS e FROM part)
SELECT CASE WHEN p = 0 THEN CASE k WHEN 0 THEN 'NOT_EXTRACTED' ELSE 'KNOWLEDGE_ONLY' END WHEN e THEN 'OK' WHEN m > 0 THEN 'PATIENT_MOTIF_WITHOUT_EVIDENCE' ELSE 'PATIENT_NOT_RECOGNIZED' END AS state, count(*) AS n FROM q GROUP BY ALL""")
def extraction_cases(spark, sf_dir):
    k = F.col("p_partkey")
    state = knowledge.extraction_case(k % 3, k % 2, k % 5, k % 7 < 3)
    return table(spark, sf_dir, "part").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT source, count(*) AS n, avg(quality) AS mean, count_if(quality = 1 AND toxic = 0) AS strong, count_if(quality = 1 AND toxic = 1) AS medium, count_if(quality = 0) AS weak, count_if(quality IS NULL) AS none
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def quality_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    level = F.when(F.col("quality").isNull(), "none").when(F.col("quality") == 0, "weak").when(F.col("toxic") == 1, "medium").otherwise("strong")
    return aggregate.level_summary(d.select("source", "quality", level.alias("level")), ["source"], "quality", "level", ["strong", "medium", "weak", "none"])


@query("""
SELECT c.o_orderkey, CASE WHEN c.o_orderkey % 4 = 0 THEN 'rewritten' ELSE o_orderstatus END AS chosen, CASE WHEN c.o_orderkey % 4 = 0 THEN o_orderstatus END AS original FROM orders c""")
def chosen_rewrites(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("rewritten").alias("text"))
    return contracts.apply_rewrites(o.select("o_orderkey", F.col("o_orderstatus").alias("chosen")), new, "o_orderkey", "chosen", "text")
