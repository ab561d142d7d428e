import pytest

from corpusloom.operators import aliases, joins

SEEK = lambda *terms: {"field": "text", "operator": "contains_any", "value": list(terms)}
PROTOCOL = {"motifs": [
    {"rule_id": "R1", "motif": {"fr": "Douleur thoracique", "en": "Chest pain"}, "keywords": {"en": ["Heart attack"], "fr": None}, "triage_levels": {
        "1": {"automation": {"all": [SEEK("heart attack", "crushing pain", "pain", " Perte de connaissance ", ""), {"any": [SEEK("blood loss"), {"field": "age", "operator": ">", "value": 60}]}]}},
        "2": {"automation": [SEEK("crushing pain", "unclear term", "CHEST PAIN")]},
        "3": "none",
    }},
    {"rule_id": "R2", "triage_levels": {"1": {"automation": {"field": "text", "operator": "equals", "value": ["blood"]}}, "2": {"automation": SEEK("fièvre", "perte of blood", "heart attack")}}},
    {"rule_id": None, "triage_levels": {"1": {"automation": SEEK("blood")}}},
    {"rule_id": "R3"},
]}


def test_aliases(spark):
    known = aliases.vocabulary(spark, PROTOCOL)
    found = aliases.aliases(aliases.condition_terms(spark, PROTOCOL), known)
    assert sorted(map(tuple, found.collect())) == [
        ("R1", "en", "blood loss"), ("R1", "en", "crushing pain"), ("R1", "fr", "Perte de connaissance"),
        ("R2", "en", "heart attack"), ("R2", "en", "perte of blood"), ("R2", "fr", "perte of blood"),
    ]
    rules = spark.createDataFrame([("R1",), ("R2",), ("R3",)], "rule_id string")
    assert aliases.unknown_rules(found, rules).count() == 0
    assert aliases.unknown_rules(found, rules.where("rule_id <> 'R2'")).collect() == [("R2",)]
    assert aliases.repeated_keywords(found, known).count() == 0
    more = spark.createDataFrame([("R1", "en", "HEART attack"), ("R1", "fr", "heart attack"), ("R2", "en", "heart attack")], "rule_id string, lang string, term string")
    assert list(map(tuple, aliases.repeated_keywords(more, known).collect())) == [("R1", "en", "HEART attack")]
    docs = spark.createDataFrame([(1, "en", "A crushing  pain, then blood-loss"), (2, "fr", "crushing pain")], "id int, lang string, text string")
    assert sorted(map(tuple, joins.lexicon_matches(docs, found, "id").collect())) == [(1, "R1", "blood loss"), (1, "R1", "crushing pain")]


@pytest.mark.parametrize("protocol", [{}, {"motifs": []}, {"motifs": [{"rule_id": "R", "triage_levels": None, "motif": None, "keywords": None}]}])
def test_no_aliases(spark, protocol):
    assert aliases.aliases(aliases.condition_terms(spark, protocol), aliases.vocabulary(spark, protocol)).count() == 0
