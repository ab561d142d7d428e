"""Scored lexicon matches against a plain loop over all terms."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import lexicon

TERMS = [("R1", "en", "chest pain"), ("R1", "fr", "Douleur thoracique"), ("R2", "en", "pain"), ("R2", "en", "shortness of breath"), ("R3", "en", "severe head injury today"), ("R3", "fr", "fièvre"), ("R4", "en", "head"), ("R4", "fr", "tête"), ("R5", "en", "cold"), ("R5", "en", "snake_bite"), ("R6", "en", None), (None, "en", "head"), ("R7", "en", "!!!")]


def term_score(text, term):
    if f" {term} " in f" {text} ":
        return 2.0
    words = [w for w in term.split() if len(w) >= 4]
    return 1.0 if len(words) >= 2 and sum(w in text.split() for w in words) / len(words) >= 0.75 else 0.0


def by_loop(text, fields):
    rules = {}
    for rule, _, term in TERMS:
        t = lexicon.folded(term)
        if rule and t and t not in ("infection", "pain", "douleur", "fever", "fievre", "bleeding", "saignement"):
            rules.setdefault(rule, set()).add(t)
    body = lexicon.folded(" ".join(v for v in [text, *fields.values()] if v))
    out = []
    for rule, terms in rules.items():
        score = sum(term_score(body, t) for t in terms)
        score += 0.5 * sum(any(term_score(lexicon.folded(v), t) for t in terms) for v in fields.values() if v)
        if score > 0:
            out.append((rule, score))
    out.sort(key=lambda x: (-x[1], x[0]))
    best, second = (out[0][1] if out else 0.0), (out[1][1] if len(out) > 1 else 0.0)
    status = "no_match" if not out else "weak_match" if best < 2 else "ambiguous_match" if best - second < 1 else "unique_match"
    return status, best, [r for r, _ in (out[:1] if status == "unique_match" else out[:5])]


def test_scores_against_a_loop(spark):
    rnd = random.Random(5)
    words = ["chest", "pain", "douleur", "thoracique", "shortness", "of", "breath", "severe", "head", "injury", "today", "fièvre", "tête", "cold", "snake_bite", "Snake", "bite", "xx", "HEAD,", "ﬁèvre"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))), rnd.choice([None, "", "chest pain", "Tête !"]), rnd.choice([None, "severe injury head", "x"])) for i in range(300)] + [(300, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, a string, b string")
    lex = spark.createDataFrame(TERMS, "rule_id string, lang string, term string")
    out = df.select("id", lexicon.resolved(lexicon.scored_rules(lex, F.col("text"), {"a": F.col("a"), "b": F.col("b")})).alias("m")).collect()
    got = {r["id"]: (r["m"]["status"], r["m"]["score"], [c["rule_id"] for c in r["m"]["candidates"]]) for r in out}
    assert got == {i: by_loop(t, {"a": a, "b": b}) for i, t, a, b in rows}
    assert {v[0] for v in got.values()} == {"no_match", "weak_match", "ambiguous_match", "unique_match"}


def test_motifs_of_a_language(spark):
    lex = spark.createDataFrame(TERMS, "rule_id string, lang string, term string")
    rows = [(1, "cold head and chest pain", "en"), (2, "cold head", "fr"), (3, "tête", "fr"), (4, None, "en"), (5, "head", None), (6, "overhead pain", "en")]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    got = {r["id"]: [(m["rule_id"], m["matched_terms"]) for m in r["m"]] for r in df.select("id", lexicon.language_motifs(lex, F.col("text"), F.col("lang")).alias("m")).collect()}
    assert got == {1: [("R1", ["chest pain"]), ("R4", ["head"])], 2: [], 3: [("R4", ["tete"])], 4: [], 5: [], 6: []}


def test_a_text_is_read_without_an_exchange(spark):
    lex = spark.createDataFrame(TERMS, "rule_id string, lang string, term string")
    df = spark.createDataFrame([(1, "head")], "id int, text string")
    plan = df.select(lexicon.scored_rules(lex, F.col("text"), {}))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    assert df.select(lexicon.scored_rules(lex.where("false"), F.col("text"), {}).alias("m")).first()["m"] == []
