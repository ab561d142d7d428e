"""Judgements out of noisy answers, and the versioned store of decisions."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import judge
from corpusloom.operators.decisions import DecisionStore

GOOD = {"completeness": "pass", "relevance": "PASS", "alignment": "Review", "safety": "PASS", "confidence": "high", "reason": "well {done} \"so\" \\ }"}
FAILED = GOOD | {"safety": "fail"}


def said(**changed):
    return json.dumps(GOOD | changed)


CASES = [
    (said(), True), ("Here: " + said() + " bye", True), ("{oops} {\"a\": 1, } " + said(), True), ("{\"a\": {\"b\": 1}} " + said(), False), ('{"broken": "' + said(), True),
    (said(extra=1), False), (json.dumps({k: v for k, v in GOOD.items() if k != "reason"}), False), (said(reason=5), False), (said(reason="  "), False), (said(safety=None), False),
    (said(confidence="sure"), False), (said(safety=True), False), ("[1, 2]", False), ("", False), (None, False), ("{" * 300, False), (said(reason="é\n x"), True), ("x" * 5000 + said(), True),
    (said(reason={"a": 1}), False), ("```json\n" + json.dumps(GOOD, indent=2) + "\n```", True),
]


def first_by_loop(text):
    text = (text or "").strip()
    for k, ch in enumerate(text):
        if ch == "{":
            try:
                return json.JSONDecoder().raw_decode(text[k:])[0]
            except json.JSONDecodeError:
                pass
    return None


def test_first_object_and_strict_fields(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string")
    out = df.select("id", judge.first_object(F.col("text")).alias("o"), judge.judgement(judge.first_object(F.col("text")), judge.first_object(F.lit(None).cast("string"))).alias("j")).orderBy("id").collect()
    for r, (t, ok) in zip(out, CASES, strict=True):
        want = first_by_loop(t)
        assert r["o"]["found"] == (want is not None) and r["o"]["keys"] == sorted(want or {})
        assert r["j"]["technical"] == (not ok), t
        assert (r["j"]["verdict"], r["j"]["confidence"]) == (("REVIEW", "HIGH") if ok else ("REVIEW", "LOW"))
    assert out[0]["j"]["reason"] == GOOD["reason"] and out[5]["j"]["reason"] == "Sortie invalide après deux tentatives : ValueError / ValueError."


def test_second_answer_and_verdicts(spark):
    df = spark.createDataFrame([(1, "nothing", json.dumps(FAILED)), (2, said(), json.dumps(FAILED)), (3, said(alignment="pass"), None)], "id int, a string, b string")
    got = {r["id"]: r["j"]["verdict"] for r in df.select("id", judge.judgement(judge.first_object(F.col("a")), judge.first_object(F.col("b"))).alias("j")).collect()}
    assert got == {1: "FAIL", 2: "REVIEW", 3: "PASS"}


def test_decisions_are_taken_once(spark, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    records = lambda *rows: spark.createDataFrame(rows, "id long, text string").withColumn("content_hash", F.sha2("text", 256))
    asked = []

    def judge_all(df):
        asked.append(sorted(r["id"] or -1 for r in df.collect()))
        return df.select("id", "content_hash", F.lit("PASS").alias("verdict"), F.lit("HIGH").alias("confidence"), F.lit("r").alias("reason"))

    first = records((1, "one"), (2, "two"))
    assert store.decide(first, judge_all, "v1") == 2
    assert store.decide(first, judge_all, "v1") == 0
    assert store.decide(records((1, "one"), (2, "changed"), (3, "three")), judge_all, "v1") == 2
    assert store.decide(first, judge_all, "v2") == 2
    assert asked == [[1, 2], [], [2, 3], [1, 2]]
    assert store.load("v1").count() == 4 and store.load("v2").count() == 2 and store.load("v3").count() == 0


def test_newest_decision_and_torn_lines(spark, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    old = spark.createDataFrame([("a", "h", "FAIL", "LOW", "x", "2024-01-01")], "id string, content_hash string, verdict string, confidence string, reason string, decided_at string")
    store.append(old, "v1")
    store.append(old.withColumns({"verdict": F.lit("PASS"), "decided_at": F.lit("2024-02-01")}), "v1")
    store.append(old.withColumns({"verdict": F.lit("REVIEW"), "decided_at": F.lit("2023-02-01")}), "v1")
    line = json.dumps({"id": "b", "content_hash": "h", "judge_version": "v1", "verdict": "PASS"})
    (tmp_path / "store" / "torn.json").write_text(line + "\n" + line[:30] + "\n\n" + json.dumps({"id": "", "content_hash": "h", "judge_version": "v1"}))
    assert {(r["id"], r["verdict"]) for r in store.load("v1").collect()} == {("a", "PASS"), ("b", "PASS")}
    assert store.torn() == 2
    left = store.pending(spark.createDataFrame([("a", "h", 1), ("b", "other", 2), (None, "h", 3), ("c", None, 4)], "id string, content_hash string, more int"), "v1")
    assert sorted(r["more"] for r in left.collect()) == [2, 3, 4] and left.columns == ["id", "content_hash", "more"]
