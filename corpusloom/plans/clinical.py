"""Extraction, rules and routing over records built from the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import extraction
from corpusloom.operators import rules

from .registry import query, spread, table

#: A small protocol that reaches every kind of decision.
PROTOCOL = {"motifs": [
    {"rule_id": "M1", "cvc": "a", "tri_m": "a", "triage_levels": {"1": {"automation": {"all": [{"field": "size", "operator": ">=", "value": 45}, {"field": "price", "operator": ">", "value": 1500}]}}, "3A": {"automation": {"any": [{"field": "size", "operator": "<", "value": 10}]}}}},
    {"rule_id": "M2", "cvc": "a", "tri_m": "b", "triage_levels": {"4": {"automation": {"all": [{"field": "price", "operator": "<=", "value": 1200}, {"field": "size", "operator": ">", "value": 20}]}}}},
    {"rule_id": "M3", "cvc": "c", "tri_m": "c", "triage_levels": {"2": {"automation": {"any": [{"field": "type", "operator": "contains_any", "value": ["brass", "STEEL"]}]}}}},
]}
SIZE = "(CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END)"
APPLIES = "CASE p_partkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'M1' WHEN 2 THEN 'M1,M2' ELSE 'M3' END"


def _records(spark, sf_dir):
    k = F.col("p_partkey") % 4
    empty = F.array().cast("array<string>")
    ids = F.when(k == 0, empty).when(k == 1, F.array(F.lit("M1"))).when(k == 2, F.array(F.lit("M1"), F.lit("M2"))).otherwise(F.array(F.lit("M3")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 6 != 0, F.col("p_size")).alias("size"), F.col("p_retailprice").alias("price"), F.col("p_type").alias("type"), ids.alias("ids"))


FIELDS = ("size", "price", "type")


@query()
def rule_decisions(spark, sf_dir):
    d = rules.decide(_records(spark, sf_dir), rules.flatten_protocol(PROTOCOL), {f: F.col(f) for f in FIELDS}, "ids", "p_partkey")
    return d.select("p_partkey", "priority", "level", "confidence", rules.confidence_label(F.col("confidence")).alias("label"), "method", F.array_join("rule_ids", ",").alias("rule_ids"), F.array_join("missing", ",").alias("missing"))


@query(f"""
WITH r AS (SELECT p_partkey, {SIZE} AS size, p_retailprice AS price, ' ' || lower(p_type) || ' ' AS type FROM part)
SELECT p_partkey,
  CASE WHEN size >= 45 AND price > 1500 THEN 'matched' WHEN NOT (size >= 45 AND price > 1500) THEN 'not_matched' ELSE 'missing' END AS m1,
  CASE WHEN size < 10 THEN 'matched' WHEN NOT size < 10 THEN 'not_matched' ELSE 'missing' END AS m1b,
  CASE WHEN price <= 1200 AND size > 20 THEN 'matched' WHEN NOT (price <= 1200 AND size > 20) THEN 'not_matched' ELSE 'missing' END AS m2,
  CASE WHEN type LIKE '% brass %' OR type LIKE '% steel %' THEN 'matched' ELSE 'not_matched' END AS m3,
  (CASE WHEN price <= 1200 THEN 1.0 ELSE 0.0 END + CASE WHEN size > 20 THEN 1.0 ELSE 0.0 END) / 2 AS score2 FROM r""")
def condition_states(spark, sf_dir):
    c = rules.Compiler({f: F.col(f) for f in FIELDS})
    tree = {(m["rule_id"], k): v["automation"] for m in PROTOCOL["motifs"] for k, v in m["triage_levels"].items()}
    named = {"m1": ("M1", "1"), "m1b": ("M1", "3A"), "m2": ("M2", "4"), "m3": ("M3", "2")}
    return _records(spark, sf_dir).select("p_partkey", *[c.status(tree[k]).alias(n) for n, k in named.items()], c.score(tree["M2", "4"]).alias("score2"))


@query(f"""
WITH e AS (SELECT p_partkey, size, price, ' ' || lower(type) || ' ' AS type, applies FROM (SELECT p_partkey, {SIZE} AS size, p_retailprice AS price, p_type AS type, {APPLIES} AS applies FROM part)),
h AS (SELECT p_partkey, applies, applies LIKE 'M1%' AND coalesce(size >= 45 AND price > 1500, false) AS a, applies LIKE 'M1%' AND coalesce(size < 10, false) AS b, applies = 'M1,M2' AND coalesce(price <= 1200 AND size > 20, false) AS c, applies = 'M3' AND (type LIKE '% brass %' OR type LIKE '% steel %') AS d FROM e)
SELECT p_partkey, CASE WHEN applies = 'none' THEN 'no_patient_motif' WHEN (a::INT + b::INT + c::INT) > 1 THEN 'exact_rule_conflict' WHEN a OR b OR c OR d THEN 'exact_rule' ELSE 'partial' END AS kind,
  CASE WHEN (a::INT + b::INT + c::INT) > 1 THEN NULL WHEN a THEN 1 WHEN b THEN 2 WHEN c THEN 3 WHEN d THEN 1 END AS exact_priority FROM h""")
def exact_decisions(spark, sf_dir):
    d = rule_decisions(spark, sf_dir)
    exact = F.col("method").startswith("exact")
    return d.select("p_partkey", F.when(exact | (F.col("method") == "no_patient_motif"), F.col("method")).otherwise("partial").alias("kind"), F.when(exact, F.col("priority")).alias("exact_priority"))


@query("""
SELECT o_orderkey, CASE
  WHEN o_orderkey % 97 = 0 THEN 'HUMAN_EXCLUSION' WHEN o_orderkey % 89 = 0 THEN 'SCHEMA_ERROR' WHEN o_orderkey % 13 = 0 THEN 'PRIVACY_REVIEW_REQUIRED' WHEN o_orderkey % 11 = 0 THEN 'CLINICAL_CONFLICT'
  WHEN o_orderkey % 2 = 0 AND o_custkey % 3 = 0 THEN 'PATIENT_AND_FRENCH_EVIDENCE' WHEN o_orderkey % 2 = 0 AND o_custkey % 5 = 0 THEN 'PATIENT_WITH_KNOWLEDGE_MOTIF_ONLY' WHEN o_orderkey % 2 = 0 THEN 'PATIENT_WITHOUT_FRENCH_MOTIF'
  WHEN o_custkey % 4 = 0 AND o_custkey % 5 = 0 THEN 'MEDICAL_KNOWLEDGE_AND_FRENCH_MOTIF' WHEN o_custkey % 4 = 0 THEN 'MEDICAL_KNOWLEDGE_AVAILABLE' WHEN o_custkey % 3 = 0 OR o_custkey % 5 = 0 THEN 'FRENCH_MOTIF_WITHOUT_PATIENT_EVIDENCE'
  WHEN o_custkey % 7 = 0 THEN 'MEDICAL_INFORMATION_WITHOUT_TRIAGE_TARGET' ELSE 'NO_USABLE_TRIAGE_INFORMATION' END AS reason FROM orders""")
def routing_reasons(spark, sf_dir):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    r = rules.route(o % 97 == 0, o % 89 == 0, o % 13 == 0, o % 11 == 0, o % 2 == 0, c % 3 == 0, c % 5 == 0, c % 4 == 0, c % 7 == 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", r["reason"].alias("reason"))


@query("""
WITH r AS (SELECT l_orderkey AS k, l_partkey % 5 AS rule_id, bool_and(l_linenumber % 2 = 1) AS resolved, list_sort(list_distinct(list((l_quantity % 3 + 1)::INT))) AS p FROM lineitem GROUP BY 1, 2),
g AS (SELECT k, bool_and(resolved) AS all_resolved, list(p) AS ps, list_sort(list_distinct(flatten(list(p)))) AS u, list_sort(list_distinct(flatten(list(p) FILTER (resolved)))) AS firm, count(*) AS n FROM r GROUP BY k),
h AS (SELECT *, list_filter(u, lambda x: len(list_filter(ps, lambda p: list_contains(p, x))) = n) AS common FROM g)
SELECT k, CASE WHEN all_resolved AND len(u) = 1 THEN 'knowledge_reference' WHEN all_resolved THEN 'knowledge_priority_conflict' WHEN len(u) = 1 THEN 'knowledge_full_convergence_review'
  WHEN len(common) = 1 THEN 'knowledge_common_priority_review' WHEN len(firm) = 1 AND list_contains(common, firm[1]) THEN 'knowledge_resolved_dominance_review' ELSE 'knowledge_priority_conflict' END AS method,
  CASE WHEN all_resolved AND len(u) = 1 THEN u[1] END AS priority FROM h""")
def knowledge_references(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    refs = li.groupBy(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 5).cast("string").alias("rule_id")).agg(F.bool_and(F.col("l_linenumber") % 2 == 1).alias("resolved"), F.array_sort(F.collect_set((F.col("l_quantity") % 3 + 1).cast("int"))).alias("priorities"))
    return rules.resolve_references(refs, "k").select("k", "method", "priority")


@query("""
SELECT p_partkey, (p_partkey % 90 + 5)::DOUBLE AS age, CASE WHEN p_partkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CASE WHEN p_partkey % 7 <> 0 THEN (p_size + 60)::DOUBLE END AS heart_rate,
  (p_size + 100)::DOUBLE AS systolic, (p_size + 30)::DOUBLE AS diastolic, CASE WHEN p_partkey % 7 <> 0 THEN (p_size + 60) / (p_size + 100) END AS shock_index, (p_partkey % 9 + 1) * 1440.0 AS minutes, round(36 + (p_size % 10) / 10.0, 1)::DOUBLE AS temperature,
  CASE WHEN p_partkey % 3 = 0 THEN 'PRESENT' WHEN p_partkey % 3 = 1 THEN 'ABSENT' ELSE 'UNKNOWN' END AS fever FROM part""")
def clinical_facts(spark, sf_dir):
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    s, k = F.col("p_size"), F.col("p_partkey")
    t = F.concat(F.when(k % 2 == 0, "Homme de ").otherwise("Femme de "), (k % 90 + 5).cast("string"), F.lit(" ans. FC: "), (s + 60).cast("string"), F.when(k % 7 == 0, F.concat(F.lit(" puis 3"), (s % 10).cast("string"), F.lit(" bpm"))).otherwise(""), F.lit(", TA "), (s + 100).cast("string"), F.lit("/"), (s + 30).cast("string"),
                 F.lit(", T 36."), (s % 10).cast("string"), F.lit(" °C depuis "), (k % 9 + 1).cast("string"), F.lit(" jours. "), F.when(k % 3 == 0, "fever present").when(k % 3 == 1, "no fever").otherwise("nothing"))
    p = p.select("p_partkey", "p_size", t.alias("t"))
    x = F.col("t")
    p = p.select("p_partkey", extraction.age(x).alias("age"), extraction.sex(x).alias("sex"), extraction.vital(x, "heart_rate").alias("heart_rate"), extraction.pressure(x).alias("bp"),
                 extraction.duration_minutes(x).alias("minutes"), extraction.temperature(x).alias("temperature"), extraction.tri_state(x, r"(?i)\bfever\b", r"(?i)\bno fever\b").alias("fever"))
    return p.select("p_partkey", extraction.in_years(F.col("age")).alias("age"), "sex", "heart_rate", F.col("bp.s").alias("systolic"), F.col("bp.d").alias("diastolic"), extraction.shock_index(F.col("heart_rate"), F.col("bp.s")).alias("shock_index"), "minutes", "temperature", "fever")
