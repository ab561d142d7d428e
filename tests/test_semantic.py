import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import categories, fixed_categories, fixed_concepts, fixed_signs, signs
from corpusloom.operators import semantic

SCHEMA = "family string, question string, context string, input string, answer string, choices map<string,string>, labels array<string>, chosen string, rejected string, language string, detected_language string, flags array<string>"
LONG = "The left ventricle pumps blood into the aorta."
CASES = [
    # record, verdict, score, dimensions that do not pass, reason
    ({"family": "open", "question": "Q?", "input": "Q?", "answer": "Four words stand here"}, "PASS", 1.0, {}, None),
    ({"family": "open", "question": "Q?", "input": " \n", "answer": None}, "FAIL", 0.6667, {"completeness": "FAIL", "alignment": "FAIL"}, "Entrée SFT vide. Réponse SFT vide."),
    ({"family": "open", "input": "Q?", "answer": "Click here"}, "PASS", 1.0, None, None),
    ({"family": "open", "input": "Q?", "answer": "click here"}, "FAIL", 0.8333, {"alignment": "FAIL"}, "Réponse ouverte impropre au SFT : NAVIGATION_ONLY_ANSWER."),
    ({"family": "open", "input": "Q?", "answer": "Is it so?", "flags": ["UNINFORMATIVE_ANSWER", "NEEDS_CONTEXT"]}, "REVIEW", 0.8333, {"alignment": "REVIEW", "autonomy": "REVIEW"}, "Réponse ouverte à vérifier : QUESTION_AS_ANSWER, VERY_SHORT_OPEN_ANSWER. Autonomie à vérifier : NEEDS_CONTEXT."),
    ({"family": "open", "question": "Why?  " + LONG, "input": "Q?", "answer": LONG}, "REVIEW", 0.9167, {"target_leakage": "REVIEW"}, "Réponse ouverte déjà présente dans l’entrée."),
    ({"family": "open", "question": "Why? " + LONG.upper(), "input": "Q?", "answer": LONG}, "PASS", 1.0, {}, None),
    ({"family": "open", "input": "Q?", "answer": "Four words stand here", "language": "fr", "detected_language": " EN"}, "REVIEW", 0.9167, {"language_quality": "REVIEW"}, "Langue détectée 'en' différente de 'fr'."),
    ({"family": "mcqu", "input": "Q?", "choices": {"A": "x", "B": " "}, "labels": ["A"]}, "PASS", 1.0, {}, None),
    ({"family": "mcqu", "input": "Q?", "choices": {"A": "x", "B": " "}, "labels": None}, "FAIL", 0.8333, {"alignment": "FAIL"}, "QCM sans réponse correcte."),
    ({"family": "mcqm", "input": "Q?", "choices": {"A": "x", "B": " "}, "labels": ["A", "D", "E"]}, "FAIL", 0.8333, {"alignment": "FAIL"}, "Labels absents des choix : D, E."),
    ({"family": "mcqm", "input": "Q?", "choices": {"A": "x", "B": " "}, "labels": ["A", "B"]}, "FAIL", 0.8333, {"alignment": "FAIL"}, "Choix corrects sans contenu : B."),
    ({"family": "mcqu", "question": "So the correct answer is b.", "input": "Q?", "choices": {"A": "x", "B": "y"}, "labels": ["B"], "flags": ["TEXT_ANOMALY"]}, "REVIEW", 0.8333, {"target_leakage": "REVIEW", "text_quality": "REVIEW"}, "Label correct 'B' explicitement révélé. Anomalie textuelle à vérifier."),
    ({"family": "mcqu", "question": "The answer is be.", "input": "Q?", "choices": {"A": "x", "B": "y"}, "labels": ["B"]}, "PASS", 1.0, {}, None),
    ({"family": "dpo", "question": "P", "input": "", "chosen": "a  b", "rejected": "a b", "flags": ["HIGH_RISK"]}, "FAIL", 0.8333, {"preference_consistency": "FAIL"}, "Les réponses chosen et rejected sont identiques. Contenu médical à haut risque."),
    ({"family": "dpo", "question": "P " + LONG, "chosen": "a", "rejected": LONG, "flags": ["DPO_PREFERENCE_CYCLE", "DPO_LENGTH_BIAS"]}, "FAIL", 0.75, {"preference_consistency": "FAIL", "target_leakage": "REVIEW"}, "Contradiction de préférence DPO. Réponse DPO 'rejected' déjà présente dans le prompt. Biais de longueur potentiel."),
    ({"family": "dpo"}, "FAIL", 0.8333, {"completeness": "FAIL"}, "Prompt DPO vide. Réponse chosen vide. Réponse rejected vide."),
    ({}, "FAIL", 0.6667, {"completeness": "FAIL", "alignment": "FAIL"}, "Entrée SFT vide. Réponse SFT vide."),
]
DIMENSIONS = ["completeness", "alignment", "language_quality", "autonomy", "text_quality", "target_leakage", "preference_consistency"]


def test_semantic_dimensions(spark):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = [(i, *[r.get(n) for n in names]) for i, (r, *_) in enumerate(CASES)]
    got = semantic.assess(spark.createDataFrame(rows, "id int, " + SCHEMA)).orderBy("id").collect()
    for g, (record, verdict, score, off, reason) in zip(got, CASES):
        if off is None:  # letter case counts in openings; two words are short
            assert (g.verdict, g.alignment) == ("REVIEW", "REVIEW")
            continue
        assert (g.verdict, g.quality_score, g.reason) == (verdict, score, reason), record
        assert {d: g[d] for d in DIMENSIONS if g[d] not in (None, "PASS")} == off, record
        assert (g.preference_consistency is None) == (record.get("family") != "dpo") and (g.alignment is None) == (record.get("family") == "dpo")
        assert ("SEMANTIC_REVIEW" in g.flags) == (verdict == "REVIEW") and g.status == ("SEMANTIC_QUALITY_FAILED" if verdict == "FAIL" else "ELIGIBLE")
    assert semantic.assess(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("text", "triage", "risk", "sensitive", "n"), [
    ("Détresse  respiratoire, SpO2 basse", ["RESPIRATORY_DISTRESS", "VITAL_SIGNS"], ["SEVERE_RESPIRATORY"], [], 0),
    ("depuis 3 heures: L'infection, la dose", ["ACUTE_CONTEXT"], [], [], 1),
    ("Shocking painter, AVCs, stroked", [], [], [], 0),
    ("AVC. Pain pain PAIN, fièvre: pre-eclampsia, self-harm", ["ACUTE_NEUROLOGICAL", "ACUTE_PAIN", "VITAL_SIGNS"], ["SELF_HARM_OR_SUICIDE", "NEUROLOGICAL_EMERGENCY", "PREGNANCY_OBSTETRIC"], ["MENTAL_HEALTH"], 2),
    (None, [], [], [], 0),
])
def test_medical_details(spark, text, triage, risk, sensitive, n):
    r = categories.with_medical_details(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (r.triage_categories, r.risk_categories, r.sensitive_health_categories, r.medical_marker_count) == (triage, risk, sensitive, n)
    assert r.medical_status == ["NO_MARKER_DETECTED", "MEDICAL_MARKERS_PRESENT", "MEDICAL_MARKERS_PRESENT", "MEDICAL_MARKERS_STRONG"][min(n, 3)]
    assert r.triage_marker_count == len(triage) and r.risk_flag == bool(risk)
    assert r.triage_status == ("TRIAGE_MARKERS_STRONG" if len(triage) >= 3 else "TRIAGE_MARKERS_PRESENT" if triage else "NO_TRIAGE_MARKER_DETECTED")


def test_dictionaries_are_whole():
    sizes = [len(x) for x in (fixed_categories.TRIAGE, fixed_categories.RISK, fixed_categories.SENSITIVE_HEALTH, fixed_signs.CRITICAL_SIGNS, fixed_signs.NO_CRITICAL_SIGNS, fixed_concepts.CONCEPTS, fixed_concepts.NO_CONCEPTS)]
    assert sizes == [9, 8, 6, 22, 6, 39, 17]
    assert set(fixed_signs.NO_CRITICAL_SIGNS) <= set(fixed_signs.CRITICAL_SIGNS) and set(fixed_concepts.NO_CONCEPTS) <= set(fixed_concepts.CONCEPTS)


@pytest.mark.parametrize(("text", "present", "absent", "conflicts"), [
    ("Pas de convulsions, sans cyanose", [], ["cyanosis", "seizure"], []),
    ("Convulsion ce jour; pas de convulsions hier", [], [], ["seizure"]),
    ("SEIZURES, coma; vigilance normale", ["seizure", "unconsciousness"], ["altered_consciousness"], []),
    ("no seizures and no convulsions", [], ["seizure"], []),
    ("somnolentes, macula cyanosed", [], [], []),
    ("Douleur à 10 / 10\ndetresse; nasal flaring", ["retractions", "severe_pain"], [], []),
    (None, [], [], []),
])
def test_signs_have_three_states(spark, text, present, absent, conflicts):
    found = signs.sign_states(fixed_signs.CRITICAL_SIGNS, fixed_signs.NO_CRITICAL_SIGNS)
    r = spark.createDataFrame([(text,)], "t string").select(found("t").alias("s")).first().s
    assert len(r.states) == 22 and (r.present, r.conflicts) == (present, conflicts)
    assert sorted(k for k, v in r.states.items() if v == "ABSENT") == absent


@pytest.mark.parametrize(("text", "symptoms", "conditions", "history"), [
    ("Motif: douleur, nausées et vertiges ; ab", ["douleur", "nausées", "vertiges"], [], []),
    ("Symptoms: Cough and chills\nShe complains of cough!", ["Cough", "chills"], [], []),
    ("Il consulte pour quelle raison ? Elle se plaint de la prise en charge.", [], [], []),
    ("Femme âgée, présente une toux. Diagnosed with Gout; known for GOUT.", ["une toux"], ["toux", "Gout"], []),
    ("Connu pour traitement ancien", [], [], []),
    ("ATCD: asthme, HTA\nhistory of stroke. known history of Stroke", [], [], ["asthme", "HTA", "stroke"]),
    ("Sans antécédent notable, antécédents de migraine", [], [], []),
    ("No medical history of note. " + "x" * 60 + " history of gout", [], [], ["gout"]),
    ("patient with " + "word " * 31, [], [], []),
    (None, None, None, None),
])
def test_mentions(spark, text, symptoms, conditions, history):
    t = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(signs.symptoms(t).alias("s"), signs.conditions(t).alias("c"), signs.medical_history(t).alias("h")).first()
    assert (r.s, r.c, r.h) == (symptoms, conditions, history)


@pytest.mark.parametrize(("pattern", "parts"), [
    (r"\ba(?:b|c)|\bd", [r"\ba(?:b|c)", r"\bd"]), (r"[|\]|]x|y", [r"[|\]|]x", "y"]), (r"a\|b\\|c", [r"a\|b\\", "c"]), (r"\(|b", [r"\(", "b"]), ("", [""]),
])
def test_patterns_are_cut_at_outer_bars(pattern, parts):
    assert signs._alternatives(pattern) == parts


def test_any_sign_misses_none():
    patterns = [p for d in (fixed_signs.CRITICAL_SIGNS, fixed_signs.NO_CRITICAL_SIGNS, fixed_concepts.CONCEPTS, fixed_concepts.NO_CONCEPTS) for ps in d.values() for p in ps]
    assert signs.any_sign(patterns).pattern.startswith(r"\b(?:") and not signs.any_sign([r"\ba|b"]).pattern.startswith(r"\b")
    for t in ("no fever", "xfever", "première céphalée", "Convulsion en cours", "sans\u00a0cyanose", "TC", "tcp", "rien", ""):
        assert bool(signs.any_sign(patterns).search(t)) == any(re.search(p, t, re.IGNORECASE) for p in patterns)
