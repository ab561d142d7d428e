"""Small sides are sent to every task: the large side is not exchanged, and the rows are those of an exchange."""

import pyarrow as pa

from corpusloom.functions import judge
from corpusloom.operators import joins, language, lexicon

DOCS = [(1, "en", "The of the fox, and the end"), (2, "fr", "de la terre"), (3, "en", None), (4, "en", "one two three four five six seven"), (5, "fr", "zéro un deux trois quatre cinq six")]


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_text_joins(spark, monkeypatch):
    d = spark.createDataFrame(DOCS, "doc_id int, lang string, text string")
    lex = spark.createDataFrame([("R1", "en", "the of"), ("R2", "en", "End"), ("R3", "fr", "la terre"), ("R4", "fr", "the")], "rule_id string, lang string, term string")
    items = spark.createDataFrame([(9, "one two three four five six"), (8, "nothing at all")], "item_id int, text string")
    small, held = joins.lexicon_matches(d, lex, "doc_id"), joins.containment(d, items, "doc_id", "item_id")
    assert "SortMergeJoin" not in small._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(joins, "MOST_SENT", 0)
    monkeypatch.setattr(joins, "MOST_FIRST", 0)
    assert _rows(small) == _rows(joins.lexicon_matches(d, lex, "doc_id")) == [(1, "R1", "the of"), (1, "R2", "end"), (2, "R3", "la terre")]
    assert _rows(held) == _rows(joins.containment(d, items, "doc_id", "item_id")) == [(4, 9, 2, 1.0)]


def test_languages(spark, monkeypatch):
    d = spark.createDataFrame([*DOCS, (6, "en", "1234567890 1234567890 12"), (1, "en", "un deux trois et la terre")], "doc_id int, lang string, text string")
    table = language.trigram_table(d)
    few = language.detect_languages(d, table, "doc_id")
    monkeypatch.setattr(language, "MOST_SENT", 0)
    assert "word" not in [c for line in few._jdf.queryExecution().sparkPlan().toString().splitlines() if "Aggregate(key" in line.replace(" ", "") for c in line.split("#")]
    assert _rows(few) == _rows(language.detect_languages(d, table, "doc_id"))


def test_python_holds_few_texts(monkeypatch):
    most = []
    plain = judge._objects
    monkeypatch.setattr(judge, "_objects", lambda texts: most.append(len(texts)) or plain(texts))
    out = judge._first_object(pa.array(['x {"reason": "r", "n": 1.5}', None, "[{]"] * 100)).to_pylist()
    assert max(most) <= judge.AT_ONCE and len(out) == 300
    assert out[0] == {"found": True, "keys": ["n", "reason"], "values": [("reason", "r"), ("n", "1.5")], "reason": "r"} and not out[1]["found"] and out[2]["values"] == []
    assert judge._first_object(pa.array([], pa.string())).type == judge.OBJECTS


def test_motifs_over_slices(spark):
    lex = spark.createDataFrame([("R1", "en", "red fox")], "rule_id string, lang string, term string")
    d = spark.range(200).selectExpr("id", "if(id % 2 = 0, 'a Red, fox', null) AS t", "if(id % 3 = 0, 'en', null) AS l").coalesce(1)
    got = d.select("id", lexicon.language_motifs(lex, d["t"], d["l"]).alias("m")).collect()
    assert {r.id for r in got if r.m} == {i for i in range(200) if i % 6 == 0} and lexicon.AT_ONCE < 200
