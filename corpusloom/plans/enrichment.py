"""Languages, canonical digests and cells topped up by whole groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import canonical_json
from corpusloom.operators import language, topup

from .audit import KEY
from .registry import query, table

LETTER_WORDS = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}]+'), lambda w: w <> '')"
DETECTED = f"""
WITH w AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest({LETTER_WORDS}) AS w FROM documents WHERE lang IS NOT NULL AND doc_id % 4 <> 0) GROUP BY 1, 2),
c AS (SELECT lang, gram, sum(n)::DOUBLE AS n FROM (SELECT lang, n, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM w) GROUP BY 1, 2),
t AS (SELECT lang, sum(n) + (SELECT count(DISTINCT gram) FROM c) AS total FROM c GROUP BY 1),
s AS (SELECT gram, c.lang, ln((n + 1) / total) AS score, ln(1 / total) AS floor FROM c JOIN t ON t.lang = c.lang),
d AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({LETTER_WORDS}) AS w FROM documents WHERE length({KEY}) >= 20) GROUP BY 1, 2),
g AS (SELECT doc_id, gram, sum(n) AS n FROM (SELECT doc_id, n, unnest(list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3))) AS gram FROM d) GROUP BY 1, 2),
x AS (SELECT g.doc_id, t.lang, sum(g.n * coalesce(s.score, ln(1 / t.total))) AS score FROM g CROSS JOIN t LEFT JOIN s ON s.lang = t.lang AND s.gram = g.gram GROUP BY 1, 2),
b AS (SELECT doc_id, arg_max(lang, score) AS detected FROM x GROUP BY 1),
o AS (SELECT d.doc_id, d.lang AS declared, coalesce(detected, 'unknown') AS detected, CASE WHEN detected <> d.lang AND d.lang <> '' THEN 'LANGUAGE_MISMATCH' END AS flag FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id)"""


@query(f"{DETECTED} SELECT * FROM o")
def language_mismatches(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    found = language.detect_languages(d, language.trigram_table(d.where("doc_id % 4 <> 0")), "doc_id")
    return d.select("doc_id", F.col("lang").alias("declared")).join(found, "doc_id").select("doc_id", "declared", "detected", language.mismatch(F.col("detected"), F.col("declared")).alias("flag"))


def _record():
    lines = F.split("text", "\n")
    return F.struct(
        F.col("doc_id").alias("id"), F.col("text").alias("question"),
        F.struct(F.col("source").alias("source"), F.col("lang").alias("language"), lines.alias("lines"), F.map_from_arrays(F.array(F.lit("z"), F.lit("chars")), F.array(F.lit(None).cast("double"), F.col("n_chars") / 4)).alias("sizes")).alias("metadata"),
    )


@query("""
SELECT doc_id, sha256('{"id":' || doc_id || ',"metadata":{"language":' || coalesce(to_json(lang)::VARCHAR, 'null') || ',"lines":[' || array_to_string(list_transform(string_split(text, chr(10)), lambda x: to_json(x)::VARCHAR), ',') || '],"sizes":{"chars":' || (n_chars / 4)::DOUBLE::VARCHAR || ',"z":null},"source":' || coalesce(to_json(source)::VARCHAR, 'null') || '},"question":' || to_json(text)::VARCHAR || '}') AS digest
FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL""")
def canonical_digests(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null and n_chars is not null").select("doc_id", _record().alias("record"))
    return d.select("doc_id", canonical_json.canonical_digest(F.col("record"), d.schema["record"].dataType).alias("digest"))


@query()
def cells_topped_up(spark, sf_dir):
    """Cells of status and priority filled to a fortieth of the orders from whole customers beside those of every tenth one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group"), F.concat_ws("/", "o_orderstatus", "o_orderpriority").alias("cell"))
    known = o.where("group % 10 = 0")
    return topup.top_up(known, o.where("group % 10 <> 0"), int(o.count() / 40))[1]
