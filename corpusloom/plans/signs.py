"""Symptoms, conditions, history and signs of clinical texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed_concepts, fixed_signs, signs
from corpusloom.functions.fixed_knowledge import ALIAS_EXCLUDED, LANGUAGE_MARKERS
from corpusloom.functions.text import key_text
from corpusloom.operators import aliases, medical

from .registry import query, spread, table

#: Told at the end of each document: facts, near misses and negations.
TOLD = [
    "", "Patient avec fièvre et toux depuis hier.", "Motif: douleur, nausées et vertiges ; ab", "Symptoms: cough and chills, fever", "Elle consulte pour quelle raison ?",
    "He was diagnosed with Gout. He was diagnosed with gout.", "Patiente atteinte de diabète; connue pour traitement ancien.", "Woman presents with severe pain. She complains of severe pain!",
    "ATCD: asthme, hypertension", "Sans antécédent notable, antécédents de migraine.", "History of stroke. No significant medical history of note.", "Pas de convulsions, sans cyanose, no fever.",
    "Convulsion en cours; pas de convulsions hier.", "Afebrile, not pregnant, alert and oriented.", "Coma, cyanose, hémorragie massive, open fracture.", "Inconsciente? Noncomatose feverish.",
]
PHRASE = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TOLD) + f"][doc_id % {len(TOLD)} + 1]"
Q = lambda p: "'(?i)" + p.replace("'", "''") + "'"
ALL = lambda ps: "flatten([" + ", ".join(f"regexp_extract_all(t, {Q(p)}, 1)" for p in ps) + "])"
KEPT = lambda v: rf"list_filter(list_transform({v}, lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: length(x) BETWEEN 3 AND 240 AND len(string_split(x, ' ')) <= 30)"
SECTIONS = lambda ps: KEPT(f"flatten(list_transform({ALL(ps)}, lambda x: string_split_regex(x, " + Q(r"\s*(?:,|;|\bet\b|\band\b)\s*") + ")))")
NARRATIVES = lambda ps, no: f"list_filter({KEPT(ALL(ps))}, lambda x: NOT regexp_matches(x, {Q('|'.join(no))}))"
ONCE = lambda v: f"array_to_string(list_filter({v}, lambda x, i: list_position(list_transform({v}, lambda y: lower(y)), lower(x)) = i), ' | ')"


def _told(spark, sf_dir):
    told = F.element_at(F.array(*map(F.lit, TOLD)), (F.col("doc_id") % len(TOLD) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), told).alias("t"))


def _listed(values):
    return F.array_join(F.transform(values, key_text), " | ")


@query(f"""
WITH f AS (SELECT doc_id, coalesce(text, '') || chr(10) || {PHRASE} AS t FROM documents),
m AS (SELECT doc_id, list_concat({SECTIONS(fixed_signs.SYMPTOM_SECTIONS)}, {NARRATIVES(fixed_signs.SYMPTOM_NARRATIVES, fixed_signs.NOT_SYMPTOMS)}) AS s, {NARRATIVES(fixed_signs.CONDITIONS, fixed_signs.NOT_CONDITIONS)} AS c FROM f)
SELECT doc_id, {ONCE("s")} AS symptoms, {ONCE("c")} AS conditions FROM m""")
def clinical_mentions(spark, sf_dir):
    t = F.col("t")
    return _told(spark, sf_dir).select("doc_id", _listed(signs.symptoms(t)).alias("symptoms"), _listed(signs.conditions(t)).alias("conditions"))


@query()
def medical_histories(spark, sf_dir):
    return _told(spark, sf_dir).select("doc_id", _listed(signs.medical_history(F.col("t"))).alias("medical_history"))


@query()
def clinical_signs(spark, sf_dir):
    """Critical signs and concepts present, absent and contradictory in each document."""
    kinds = {"critical": (fixed_signs.CRITICAL_SIGNS, fixed_signs.NO_CRITICAL_SIGNS), "concept": (fixed_concepts.CONCEPTS, fixed_concepts.NO_CONCEPTS)}
    d = _told(spark, sf_dir).select("doc_id", *[signs.sign_states(*p)(F.col("t")).alias(k) for k, p in kinds.items()])
    absent = lambda k: F.array_sort(F.map_keys(F.map_filter(f"{k}.states", lambda _, v: v == "ABSENT")))
    out = {f"{k}_{n}": F.array_join(v, ",") for k in kinds for n, v in (("present", F.col(f"{k}.present")), ("absent", absent(k)), ("conflicts", F.col(f"{k}.conflicts")))}
    return d.select("doc_id", *[v.alias(n) for n, v in out.items()])


#: Stands for the context of each part, so that every field of the extraction is met.
CASES = [
    "", "Homme de 40 ans, FC: 90 bpm, T 38.5 °C. Il consulte pour toux depuis 3 jours.", "Woman presents with severe pain, BP 120/80. History of asthma. Symptoms worsening.", "Nourrisson de 3 mois, SpO2 91, fièvre, sans cyanose, pas de convulsions.",
    "Gout is a chronic disease. It is treated with allopurinol. It is caused by uric acid.", "Risk factors include smoking. Complications include stroke which of the following?", "Patient de quarante ans, douleur 7/10, coma; GCS 8.",
]
#: The fields told in each of them.
PATIENT_FIELDS = [
    "", "age_years,duration,duration_minutes,sex,symptoms,vital_signs.heart_rate,vital_signs.temperature", "critical_sign_states,critical_signs,evolution,medical_history,sex,symptoms,vital_signs.diastolic_bp,vital_signs.systolic_bp",
    "age_months,critical_sign_states,french_concept_states,vital_signs.spo2", "", "", "age_years,critical_sign_states,critical_signs,vital_signs.gcs,vital_signs.pain_score",
]
KNOWLEDGE_FIELDS = ["", "", "conditions,symptoms", "", "conditions,medications,treatments,pathogens,causes", "complications,risk_factors", ""]
PICKED = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + f"][p_partkey % {len(CASES)} + 1]"


@query(f"""
WITH f AS (SELECT p_partkey, {PICKED(PATIENT_FIELDS)} AS patient_fields, {PICKED(KNOWLEDGE_FIELDS)} AS knowledge_fields FROM part)
SELECT *, patient_fields <> '' AS has_patient_information, knowledge_fields <> '' AS has_medical_knowledge FROM f""")
def medical_extractions(spark, sf_dir):
    case = F.element_at(F.array(*map(F.lit, CASES)), (F.col("p_partkey") % len(CASES) + 1).cast("int"))
    none = F.lit(None).cast("string")
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    r = part.select("p_partkey", case.alias("context"), F.col("p_name").alias("question"), none.alias("answer"), F.lit(None).cast("map<string,string>").alias("choices"), none.alias("labels"), F.lit("de").alias("language"))
    r = medical.extract_knowledge(medical.extract_patient(r)).select("p_partkey", *[F.col(f"{c}.extracted_fields").alias(c) for c in ("patient", "medical_knowledge")])
    rules = F.array().cast("array<string>")
    fields = [F.struct(F.col(c).alias("extracted_fields")) for c in ("patient", "medical_knowledge")]
    s = r.select("p_partkey", medical.extraction_summary(*fields, rules, rules).alias("s"))
    listed = lambda c: F.array_join(f"s.{c}", ",")
    return s.select("p_partkey", listed("patient_fields").alias("patient_fields"), listed("medical_knowledge_fields").alias("knowledge_fields"), "s.has_patient_information", "s.has_medical_knowledge")


SHOWN = lambda lang: "(" + " OR ".join(f"contains(lower(term), '{m}')" for m in LANGUAGE_MARKERS[lang]) + ")"
SPECIFIC = lambda lang: "lower(term) NOT IN (" + ", ".join(f"'{w}'" for w in ALIAS_EXCLUDED[lang]) + ")"


@query(f"""
WITH p AS (SELECT p_brand AS rule_id, p_partkey, p_type || CASE p_partkey % 4 WHEN 0 THEN ' Fièvre' WHEN 1 THEN ' pain' WHEN 2 THEN ' perte of blood' ELSE '' END AS long FROM part),
t AS (SELECT DISTINCT rule_id, CASE WHEN p_partkey % 9 = 0 THEN 'fièvre' WHEN p_partkey % 9 = 1 THEN 'Fever' ELSE long END AS term FROM p),
k AS (SELECT DISTINCT rule_id, lower(long) AS term FROM p WHERE p_partkey % 5 = 0)
SELECT t.rule_id, l.lang, t.term FROM t, (VALUES ('fr'), ('en')) l(lang) WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.rule_id = t.rule_id AND k.term = lower(t.term))
  AND CASE l.lang WHEN 'fr' THEN {SHOWN("fr")} AND {SPECIFIC("fr")} ELSE {SHOWN("en")} AND {SPECIFIC("en")} END""")
def rule_aliases(spark, sf_dir):
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, " Fièvre").when(k % 4 == 1, " pain").when(k % 4 == 2, " perte of blood").otherwise("")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("rule_id"), k, F.concat("p_type", said).alias("long"))
    terms = p.select("rule_id", F.when(k % 9 == 0, "fièvre").when(k % 9 == 1, "Fever").otherwise(F.col("long")).alias("term")).distinct()
    return aliases.aliases(terms, p.where(k % 5 == 0).select("rule_id", F.lower("long").alias("term")))
