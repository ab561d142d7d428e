"""Cells filled by whole groups against the sequential rule; languages by trigrams."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import language, topup


def by_loop(members, targets, seed):
    cells = defaultdict(Counter)
    for g, c in members:
        if g is not None and c is not None:
            cells[g][c] += 1
    full, out = Counter(), set()
    for g in sorted(cells, key=lambda g: (hashlib.sha256(f'[{seed},"{g}"]'.encode()).hexdigest(), g)):
        if all(full[c] + n <= targets.get(c, 0) for c, n in cells[g].items()):
            out.add(g)
            full += cells[g]
    return out


@pytest.mark.parametrize("seed", [1, 42])
def test_fill_against_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    members = [(f"g{rnd.randrange(120)}", rnd.choice("abcd")) for _ in range(500)] + [("big", "a")] * 60 + [(None, "a"), ("x", None), ("y", "no target")]
    targets = {"a": 40, "b": 25, "c": 3, "d": 0}
    got = topup.fill_cells(spark.createDataFrame(members, "group string, cell string"), spark.createDataFrame(list(targets.items()), "cell string, target long"), seed)
    assert sorted(r["group"] for r in got.collect()) == sorted(by_loop(members, targets, seed))
    empty = spark.createDataFrame([], "group string, cell string")
    assert topup.fill_cells(empty, spark.createDataFrame([("a", 1)], "cell string, target long")).count() == 0


def test_rounds_hold_only_open_groups(spark, monkeypatch):
    held, keep = [], topup.reliable

    def counted(df):
        out = keep(df)
        if "place" in df.columns:
            held.append(out.count())
        return out

    monkeypatch.setattr(topup, "reliable", counted)
    members = [(f"g{i}", "a") for i in range(400)]
    got = topup.fill_cells(spark.createDataFrame(members, "group string, cell string"), spark.createDataFrame([("a", 50)], "cell string, target long"))
    assert {r["group"] for r in got.collect()} == by_loop(members, {"a": 50}, 42)
    assert held == [400, 0]


def test_top_up_report(spark):
    rnd = random.Random(4)
    have = [(f"h{i}", rnd.choice("ab")) for i in range(30)]
    pool = [(f"p{rnd.randrange(400)}", rnd.choice("abc")) for _ in range(900)] + [("h1", "a")] * 5
    df = lambda rows: spark.createDataFrame(rows, "group string, cell string")
    taken, report = topup.top_up(df(have), df(pool), 100)
    split = {r["group"]: r["split"] for r in taken.collect()}
    assert "h1" not in split and set(split.values()) == {"train", "validation"}
    added = Counter((c, split[g]) for g, c in pool if g in split)
    for r in report.collect():
        assert (r["added_train"], r["added_validation"]) == (added[r["cell"], "train"], added[r["cell"], "validation"])
        assert r["need"] == 100 - r["have"] and r["total"] <= 100
        assert r["total"] >= 97 and abs(r["added_validation"] - 0.2 * r["need"]) <= 3


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = docs.where("lang is not null")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    table = language.trigram_table(known.where(~held))
    tested = known.where(held)
    out = language.detect_languages(tested, table, "doc_id").join(tested.select("doc_id", "lang", "text"), "doc_id").where("length(text) >= 20 and detected <> 'unknown'")
    right, n = out.agg(F.count_if(F.col("detected") == F.col("lang")), F.count(F.lit(1))).first()
    assert n > 150 and right >= 0.95 * n
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "12345 67890 !!! 12345 67890"), (5, "the and with that this from the and")], "doc_id long, text string")
    got = {r["doc_id"]: r["detected"] for r in language.detect_languages(odd, table, "doc_id").collect()}
    assert got == {1: "unknown", 2: "unknown", 3: "unknown", 4: "unknown", 5: "en"}
    flags = spark.createDataFrame([("en", "fr"), ("en", "en"), ("unknown", "fr"), ("en", None), ("en", "")], "a string, b string").select(language.mismatch(F.col("a"), F.col("b")).alias("f")).collect()
    assert [r["f"] for r in flags] == ["LANGUAGE_MISMATCH", None, None, None, None]
