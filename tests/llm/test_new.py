"""Decontamination, fill-in-the-middle and token alignment on odd rows."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import align, decontaminate, fim
from corpusloom.llm.queries import BYTE_MODEL, OP11_SQL, OP12_SQL, PIECE_MODEL, QUERIES

from ..compare import connect, same
from . import odd

SF = "/root/testdata/sf0.001"
NULL_ID = [(None, "a row without an id " * 3, "en", "s1", 1, *["clash"] * 27)]


def against_sql(out, sql, tmp_path, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    same(out, con.execute(sql))


@pytest.mark.parametrize("name,sql", [("op11_decontaminate", OP11_SQL), ("op12_fill_in_middle", OP12_SQL)])
def test_registered_queries(spark, name, sql):
    same(QUERIES[name](spark, SF), connect(SF).execute(sql))


def items(spark):
    texts = odd.texts()
    passage = texts[16].split()
    rows = [(1, " ".join(passage[5:40])), (2, " ".join(passage[:30]).upper()), (2, " ".join(passage[50:])), (10, " ".join(passage[5:40])), (None, texts[17]), (3, None), (4, ""), (5, "!!! ???"), (6, "A"), (7, " ".join(texts[18].split()[3:8])), (8, "not in any text at all of these documents anywhere"), (9, texts[0])]
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit("clash"))


@pytest.mark.parametrize("gram,most", [(7, 1_000_000), (10, 1_000_000), (1, 1_000_000), (7, 0)])
def test_decontamination_against_sql(spark, tmp_path, monkeypatch, gram, most):
    monkeypatch.setattr(decontaminate, "MOST_PRINTS", most)  # 0: nothing is broadcast by hand
    docs, bench = odd.table(spark, NULL_ID), items(spark)
    out = decontaminate.contamination(docs, bench, gram=gram, digest=True)
    assert out.where("contaminated").count() > 5 and out.where("not contaminated").count() > 5
    against_sql(out, OP11_SQL, tmp_path, documents=docs, benchmark=bench)


def test_decontamination_of_empty_tables(spark):
    docs, bench = odd.table(spark), items(spark)
    none = decontaminate.contamination(docs, bench.where("false")).collect()
    assert len(none) == docs.count() and not any(r["contaminated"] or r["items"] for r in none)
    assert decontaminate.contamination(odd.empty(spark), bench).count() == 0


def test_decontamination_plan_is_native(spark):
    plan = decontaminate.contamination(odd.table(spark), items(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def fim_rows(spark):
    tricky = ["\x01\x02 \x01e \x01c\x02", " \n\t ", " a", "a ", "a\x0bb\x0cc\rd", "x<P>y", "x <S", "<M >", "é ü \U0001f600 z", "$1 \\1 $", "w " * 5000]
    rows = [(1000 + 50 * k + i, t, "en", "s1", 1, *["clash"] * 27) for i, t in enumerate(tricky) for k in range(4)]
    return odd.table(spark, [*NULL_ID, *rows])


def test_fill_in_middle_against_sql(spark, tmp_path):
    docs = fim_rows(spark)
    out = fim.fill_in_middle_digests(fim.fill_in_middle(docs))
    assert {r["form"] for r in out.select("form").distinct().collect()} == {"plain", "psm", "spm"}
    against_sql(out, OP12_SQL, tmp_path, documents=docs)
    assert fim.fill_in_middle(odd.empty(spark)).count() == 0


def test_fill_in_middle_parts(spark):
    docs = fim_rows(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id >= 0").collect()}
    for rate, spm in ((100, 0), (100, 100), (0, 50)):
        rows = fim.fill_in_middle(docs.where("doc_id >= 0"), rate=rate, spm=spm).withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
        for r in rows:
            t = texts[r["doc_id"]]
            units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
            assert r["again"] == t and r["n"] == len(units)
            if r["form"] == "plain":
                assert rate == 0 or t == "" or any(m in t for m in ("<P>", "<S>", "<M>"))
                continue
            x = hashlib.sha256(f"42:{r['doc_id']}".encode()).hexdigest()
            a, b = sorted(int(x[k : k + 8], 16) % (len(units) + 1) for k in (0, 8))
            assert (r["prefix"], r["middle"], r["suffix"]) == ("".join(units[:a]), "".join(units[a:b]), "".join(units[b:]))


FILES = align.Tokenizers(BYTE_MODEL, PIECE_MODEL)


def aligned(rows, links):
    """Every document by itself, from the libraries' tokens of the whole text."""
    a, b = FILES.open()
    of_a, of_b = align.vocabulary(a, b)
    found, total = [], collections.Counter()
    for i, t in rows:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        want = (" " + (t or "")).encode()
        if b"".join(of_a[k] for k in x) != want or b"".join(of_b[k] for k in y) != want:
            x = y = []
        spans = lambda ids, of: [(k, e - len(of[k]), e) for k, e in zip(ids, [sum(len(of[j]) for j in ids[: n + 1]) for n in range(len(ids))], strict=True)]
        sx, sy = spans(x, of_a), spans(y, of_b)
        cuts = sorted({e for *_, e in sx} & {e for *_, e in sy})
        groups, before = [], 0
        for c in cuts:
            groups.append(",".join(str(k) for k, _, e in sx if before < e <= c) + "|" + ",".join(str(k) for k, _, e in sy if before < e <= c))
            before = c
        linked = [(p, q) for p, s, e in sx for q, u, v in sy if (e == v if links == "ends" else s < v and u < e)]
        total.update(linked)
        found.append((i, len(x), len(y), len(cuts), linked, ";".join(groups)))
    best = collections.defaultdict(int)
    for (_, q), n in total.items():
        best[q] = max(best[q], n)
    return [(i, n, m, g, len(k), sum(total[p] == best[p[1]] for p in k), sum(total[p] for p in k), s) for i, n, m, g, k, s in found], total


@pytest.mark.parametrize("links", ["ends", "overlap"])
def test_alignment_against_the_libraries(spark, links):
    odd_texts = ["<|endoftext|> <s> </s>", "a  b   c ", " lead", "\n\n x\n y \n  z\t\tq", "has \u2581 mark", "x\u00a0 y\u3000 z", "don't we'll 12,345 a.b!! ", "\U0001f600 \U0001f600\u200d x", "\x00 a \x1c b\x85 c", "one\r\n two", "the the the the"]
    rows = [(i, t) for i, t in enumerate(odd.texts()) if t is None or len(t) < 900] + [(100 + i, t) for i, t in enumerate(odd_texts * 2)] + [(None, "no id"), (100, odd_texts[0])]
    want, total = aligned(rows, links)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("clash")).repartition(3)
    out, counts = align.align_documents(docs, FILES, links=links)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {(r["a"], r["b"]): r["count"] for r in counts.collect()} == dict(total)
    digests = {(r["doc_id"], r["groups"]) for r in align.align_documents(docs, FILES, links=links, digest=True)[0].collect()}
    assert digests == {(r[0], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want}


def test_alignment_of_empty_tables_and_long_words(spark):
    docs = spark.createDataFrame([(1, "x" * 20000), (2, None)], "doc_id long, text string")
    assert align.align_documents(docs.where("false"), FILES)[0].count() == 0
    assert [r["n_a"] for r in align.align_documents(docs.where("doc_id = 2"), FILES)[0].collect()] == [0]
    row = align.align_documents(docs, FILES)[0].where("doc_id = 1").first()
    want, _ = aligned([(1, "x" * 20000)], "ends")
    assert tuple(row) == want[0]


def test_stages_carry_columns_of_any_name(spark):
    import corpus_pipeline
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    names = ["a b", "x-y", "é:1", "a.b", "tick`", "_held", "rest"]
    schema = StructType([StructField("doc_id", LongType(), False), StructField("text", StringType()), StructField("source", StringType()), StructField("lang", StringType()), *[StructField(n, StringType(), k % 2 == 0) for k, n in enumerate(names)]])
    passage = " ".join(f"word{i}" for i in range(40))
    texts = [passage + " end one", passage + " other end " + " ".join(f"x{i}" for i in range(90)), "short text here"]
    docs = spark.createDataFrame([(i, t, "s", "en", *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)], schema)
    for stage in (corpus_pipeline.language_id, corpus_pipeline.simhash_near_dedup, corpus_pipeline.substring_dedup, corpus_pipeline.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}{r['doc_id']}" for n in names]


def test_largest_and_smallest_ids(spark):
    from corpusloom.llm import simhash, vectors

    top, low = (1 << 63) - 1, -(1 << 63)
    docs = spark.createDataFrame([(top, "one text of its own"), (low, "two three four five"), (None, "nothing has an id here")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in simhash.simhash_components(docs).collect()} == {(top, top), (low, low), (None, None)}
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in simhash.near_copies(docs).collect()} == {(top, top, True), (low, low, True), (None, None, True)}
    rows = spark.createDataFrame([(top, [1.0, 0.0], 1), (low, [0.0, 1.0], 1), (None, [-1.0, 0.0], 1), (5, None, 1)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in vectors.near_vectors(rows).collect()} == {(top, 0, top, True), (low, 0, low, True), (None, 0, None, True), (5, 0, 5, True)}
