import pytest
from pyspark.sql import functions as F

from corpusloom.functions import extraction, fixed_fields, signs
from corpusloom.operators import medical


@pytest.mark.parametrize(("text", "minutes", "evolution"), [
    ("Elle consulte pour toux depuis 2,5 jours", 3600.0, None),
    ("depuis 3 jours puis depuis 4 jours", None, None),
    ("for 2 weeks. Since 2  Weeks: sudden onset", 20160.0, "sudden"),
    ("apparue il y a 30 minutes, symptoms worsening, condition stable", 30.0, None),
    ("for 3 days", 4320.0, None),
    ("for three days, unstable", None, None),
    ("Son état s'aggrave depuis 1 an", 525960.0, "worsening"),
    (None, None, None),
])
def test_duration_and_evolution(spark, text, minutes, evolution):
    t = F.col("t")
    r = spark.createDataFrame([(text,)], "t string").select(extraction.duration_minutes(t).alias("m"), extraction.evolution(t).alias("e")).first()
    assert (r.m, r.e) == (minutes, evolution)


def test_patient(spark):
    schema = "id int, context string, question string, patient_id string"
    told = "Femme de 30 ans, T 39 °C, TA 12/8 cmHg, pas de convulsions; Convulsion brève. Elle consulte pour toux."
    rows = spark.createDataFrame([(1, told, None, "x"), (2, None, None, None), (3, " ", "no fever", "")], schema)
    got = {r.id: r.patient for r in medical.extract_patient(rows).collect()}
    p = got[1]
    assert (p.age_years, p.age_days, p.sex, p.vital_signs.temperature, p.vital_signs.gcs) == (30, None, "female", 39.0, None)
    assert (p.vital_signs.systolic_bp, p.vital_signs.diastolic_bp) == (120.0, 80.0)
    assert p.critical_sign_conflicts == ["seizure"] and p.critical_signs == [] and p.symptoms == ["toux"]
    assert p.extracted_fields == ["age_years", "sex", "symptoms", "vital_signs.diastolic_bp", "vital_signs.systolic_bp", "vital_signs.temperature"]
    assert got[2].extracted_fields == [] and got[2].symptoms == [] and set(got[2].critical_sign_states.values()) == {"UNKNOWN"}
    assert got[3].extracted_fields == ["french_concept_states"] and got[3].french_concept_states["fever"] == "ABSENT"
    assert medical.extract_patient(rows.limit(0)).count() == 0


FIELD_CASES = [
    ("conditions", "She has a chronic cough. She has a cough.", ["chronic cough"]),
    ("symptoms", "Symptoms: rash, itching; x. Associated with RASH, itching", ["rash, itching"]),
    ("medications", "He was started on aspirin, which of the following is right", ["aspirin"]),
    ("treatments", "There is no cure for now. Treatment: rest", ["rest", "for now"]),
    ("procedures", "She underwent an appendectomy.", ["an appendectomy"]),
    ("laboratory_findings", "It showed elevated lactate. It showed lactate.", ["elevated lactate"]),
    ("imaging_findings", "IRM : lésion; MRI shows a mass", ["lésion", "a mass"]),
    ("diagnostic_tests", "Confirmed by biopsy.", ["biopsy"]),
    ("complications", "It can lead to sepsis.", ["sepsis"]),
    ("risk_factors", "Smoking increases the risk of stroke.", ["stroke"]),
    ("pathogens", "A virus called EBV.", ["EBV"]),
    ("causes", "Due to this. Due to treatment. Due to it", []),
    ("causes", None, None),
]


@pytest.mark.parametrize(("field", "text", "found"), FIELD_CASES)
def test_knowledge_fields(spark, field, text, found):
    assert spark.createDataFrame([(text,)], "t string").select(signs.knowledge_field(F.col("t"), field).alias("v")).first().v == found


def test_knowledge(spark):
    assert len(fixed_fields.FIELDS) == 12
    schema = "id int, question string, context string, answer string, choices map<string,string>, labels string, language string"
    rows = [
        (1, "What are the symptoms of gout?", None, "Joint pain 90% frequency of gout 5/10 Fever 50/100", None, None, "en"),
        (2, "Pick one", "The heart", None, {"a": "caused by iron", "B": "caused by zinc"}, "A", "en"),
        (3, None, None, None, None, None, None),
    ]
    got = {r.id: r.medical_knowledge for r in medical.extract_knowledge(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].intent == "symptoms" and got[1].question_subject == "gout" and got[1].symptoms == ["Joint pain", "Fever"]
    assert got[2].causes == ["iron"] and got[2].pathogens == ["iron"] and got[2].anatomy == ["heart"] and [d.text for d in got[2].distractors] == ["caused by zinc"]
    assert got[2].extracted_fields == ["pathogens", "causes", "anatomy"] and got[2].has_correct_answer
    assert got[3].extracted_fields == [] and not got[3].has_source_medical_information and got[3].question is None


def test_recovery_only_fills_what_is_missing(spark):
    rows = [(["a"], "unique_match", ["b"]), ([], "unique_match", ["b"]), (None, "ambiguous_match", ["b", "c"]), (None, None, None), ([], "unique_match", None)]
    df = spark.createDataFrame(rows, "c array<string>, s string, r array<string>")
    got = [r.v for r in df.select(medical.recovered_candidates(F.col("c"), F.col("s"), F.col("r")).alias("v")).collect()]
    assert got == [["a"], ["b"], [], [], []]
