import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import categories, extraction, fixed_categories, fixed_clinical, fixed_concepts, fixed_fields, fixed_signs, gates, knowledge
from corpusloom.plans import catalogue
from corpusloom.plans.signs import CASES, TOLD

GROUPS = [fixed_signs.CRITICAL_SIGNS, fixed_signs.NO_CRITICAL_SIGNS, fixed_concepts.CONCEPTS, fixed_concepts.NO_CONCEPTS, fixed_fields.FIELDS, fixed_clinical.NUMBERS, fixed_clinical.AGE, fixed_signs.EVOLUTIONS]
TEXTS = [*TOLD, *CASES, "ACR. DÉTRESSE RESPIRATOIRE", "ſeizure, convulſions", "İnconscient, conscıence altérée", "FIÈVRE, Kyanosis", "T 39 °C; TA 12/8 cmHg, FC 90", ""]


@pytest.mark.parametrize("group", GROUPS)
def test_every_pattern_needs_something_and_no_match_is_without_it(group):
    for p in (p for ps in group.values() for p in ps):
        words = gates.needed(p)
        assert words and all(words)
        for t in (v for t in TEXTS for v in (t, t.upper(), t.lower())):
            assert any(w in gates.plain_case(t) for w in words) or not re.search(p, t, re.IGNORECASE)


def test_needed_strings():
    assert gates.needed(r"\b(?:no|without)\s+fever\b") == ("fever",)
    assert gates.needed(r"a(?:bc)?|xy") == ("a", "xy") and gates.needed(r"\d+|x") is None and gates.needed(r"x*(?!yes)") is None


def test_gated_matches_equal_plain_ones(spark):
    ps = [p for v in fixed_clinical.NUMBERS.values() for p in v]
    d = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    plain = F.flatten(F.array(*[F.regexp_extract_all("t", F.lit("(?iU)" + p), F.lit(1)) for p in ps]))
    either = F.col("t").rlike("(?iU)" + "|".join(ps))
    got = d.select(gates.all_matches(F.col("t"), ps, "(?iU)").alias("a"), plain.alias("b"), gates.matches_any(F.col("t"), ps, "(?iU)").alias("c"), either.alias("d")).collect()
    assert all(r.a == r.b and r.c == r.d for r in got) and any(r.a for r in got)


def test_values_are_computed_once():
    plan = lambda c: str(c._jc if hasattr(c, "_jc") else c)
    assert plan(extraction.vital(F.col("t"), "heart_rate")).count("regexp_extract_all") == len(fixed_clinical.NUMBERS["heart_rate"])


@pytest.mark.parametrize("name", ["clinical_facts", "medical_extractions"])
def test_one_small_file_is_dealt_to_many_tasks(spark, name):
    assert catalogue.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_categories_and_anatomy_are_gated(spark):
    d = spark.createDataFrame([("Severe CHEST pain, coma; le cœur", "fr"), ("nothing", "en"), ("The HEART", "en"), (None, "fr")], "t string, lang string")
    found = d.select(F.array_join(categories.detect(categories.folded(F.col("t")), fixed_categories.TRIAGE), ",").alias("c"), F.array_join(knowledge.anatomy(F.col("t"), F.col("lang")), ",").alias("a"))
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") > len(fixed_categories.TRIAGE)
    got = found.collect()
    assert got[0].c == "CONSCIOUSNESS,ACUTE_PAIN" and got[0].a == "cœur" and got[1] == ("", "") and got[2] == ("", "heart") and got[3].c == ""
