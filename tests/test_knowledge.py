import pytest
from pyspark.sql import functions as F

from corpusloom.functions import fingerprints, knowledge
from corpusloom.operators import contracts


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first().v


def test_intent_and_subject_of_questions(spark):
    asked = {
        "What are the signs and symptoms of gout?": ("symptoms", "gout"),
        "WHAT IS (are) Gout ?": ("definition", "Gout"),
        "Quelles sont les causes de l'asthme ?": ("causes", "l'asthme"),
        "  Who is at risk for gout?? ": ("risk", "gout"),
        "Symptomatic gout": (None, None),
        "": (None, None),
    }
    rows = spark.createDataFrame([(q,) for q in [*asked, None]], "q string")
    q = F.col("q")
    got = {r.q: (r.i, r.s) for r in rows.select("q", knowledge.question_intent(q).alias("i"), knowledge.question_subject(q).alias("s")).collect()}
    assert got == asked | {None: (None, None)}


def test_anatomy_needs_whole_words_and_a_known_language(spark):
    texts = [("Heart-lungs, skinny earth", "en-US", ["heart", "lungs"]), ("le CŒUR, l'œil, rateau", "fr", ["cœur", "œil"]), ("heart", "de", []), ("heart", None, []), (None, "en", [])]
    rows = spark.createDataFrame([(t, lang) for t, lang, _ in texts], "t string, lang string")
    assert [r.v for r in rows.select(knowledge.anatomy(F.col("t"), F.col("lang")).alias("v")).collect()] == [e for *_, e in texts]


def test_answers_and_distractors(spark):
    choices = F.create_map(*[F.lit(x) for x in ("a", "Iron", "B", " iron ", "C", "Zinc", "D", "")])
    labels = knowledge.correct_labels(F.lit("b; A,f A"))
    assert one(spark, labels) == ["B", "A"]
    assert one(spark, knowledge.correct_answers(choices, labels, F.lit("c"))) == ["iron", "Zinc"]
    assert [tuple(x) for x in one(spark, knowledge.distractors(choices, labels))] == [("C", "Zinc")]
    nothing = F.lit(None).cast("map<string,string>")
    assert one(spark, knowledge.correct_labels(F.lit(None).cast("string"))) == []
    assert one(spark, knowledge.correct_answers(nothing, F.array().cast("array<string>"), F.lit("free text"))) == ["free text"]
    assert one(spark, knowledge.distractors(nothing, labels)) == []


@pytest.mark.parametrize("text, kept", [
    ("Input: a man\nage 40\n\nWhich is right\nAnd why?\nA. x\nB. y", "a man\nage 40"),
    ("no options here?", "no options here?"),
    ("Which?\n1) a", ""),
    ("A. first\nB. second", ""),
    ("  ", ""),
    (None, ""),
])
def test_narrative_without_options(spark, text, kept):
    assert one(spark, knowledge.clinical_narrative(F.lit(text).cast("string"))) == kept


def test_explanation_branch_and_gates(spark):
    assert one(spark, knowledge.case_explanation(F.lit("P1\nEXPLANATION:  a\nb "))) == "a\nb"
    assert one(spark, knowledge.case_explanation(F.lit(" whole "))) == "whole"
    assert one(spark, knowledge.branch_text(F.lit(""), F.lit(" q "))) == "q"
    failed = F.array(F.lit("PII_REDACTION_FAILED"))
    assert one(spark, knowledge.may_repeat(F.lit(None).cast("boolean"), failed)) and not one(spark, knowledge.may_conflict(F.lit(False), failed))
    assert one(spark, knowledge.may_conflict(F.lit(False), F.lit(None).cast("array<string>")))


def test_json_digest_is_that_of_compact_sorted_json(spark):
    import hashlib
    import json

    row = {"question": 'é "q"\n/', "answer": None, "language": "fr"}
    got = one(spark, fingerprints.json_digest({k: F.lit(v).cast("string") for k, v in row.items()}))
    assert got == hashlib.sha256(json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_rewrites_must_meet_one_row(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, chosen string")
    new = lambda *r: spark.createDataFrame(list(r), "id long, text string")
    out = contracts.apply_rewrites(rows, new((2, "c"), (1, None)), "id", "chosen", "text")
    assert {tuple(r) for r in out.select("id", "chosen", "original").collect()} == {(1, "a", None), (2, "c", "b")}
    for bad in (new((3, "c")), new((2, "c"), (2, "d"))):
        with pytest.raises(Exception, match="rewrite|rewritten"):
            contracts.apply_rewrites(rows, bad, "id", "chosen", "text").collect()
