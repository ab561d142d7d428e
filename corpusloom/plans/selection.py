"""Selection, quotas and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions.fingerprints import context_hash, seeded_order
from corpusloom.operators import joins, select, window

from .audit import KEY
from .registry import query, table

DRAW = "sha256('[42,\"' || doc_id || '\"]')"


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 5")
def top_n_per_group(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return window.first_per_group(d, [F.col("lang")], [F.desc("n_chars"), F.asc("doc_id")], 5).select("lang", "doc_id", "n_chars")


@query(f"SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {DRAW}) AS k FROM documents) WHERE k <= 3")
def cap_per_group_hash(spark, sf_dir):
    return window.first_per_group(table(spark, sf_dir, "documents"), [F.col("source")], [seeded_order(F.col("doc_id"))], 3).select("source", "doc_id")


@query(f"""
WITH q AS (SELECT * FROM (VALUES ('en', 20), ('fr', 10), ('de', 5)) v(lang, quota)),
r AS (SELECT d.doc_id, d.lang, quota, row_number() OVER (PARTITION BY d.lang ORDER BY quality DESC NULLS LAST, n_chars DESC, source, {DRAW.replace('doc_id', 'd.doc_id')}) AS k FROM documents d JOIN q USING (lang) LEFT JOIN labels ON labels.doc_id = d.doc_id)
SELECT doc_id, lang FROM r WHERE k <= quota""")
def quota_topk(spark, sf_dir):
    q = spark.createDataFrame([("en", 20), ("fr", 10), ("de", 5)], "lang string, quota int")
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(F.broadcast(q), "lang")
    order = [F.desc_nulls_last("quality"), F.desc("n_chars"), F.asc("source"), seeded_order(F.col("doc_id"))]
    return window.first_per_group(d, [F.col("lang")], order, F.col("quota")).select("doc_id", "lang")


@query("""
WITH j AS (SELECT d.doc_id, quality, n_chars FROM documents d JOIN labels USING (doc_id)), m AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM j GROUP BY quality))
SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n_chars DESC, doc_id) AS k FROM j), m WHERE k <= m.n""")
def balanced_min_class(spark, sf_dir):
    j = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "n_chars")
    least = j.groupBy("quality").count().agg(F.min("count").alias("_least"))
    both = j.crossJoin(F.broadcast(least))  # one row
    return window.first_per_group(both, [F.col("quality")], [F.desc("n_chars"), F.asc("doc_id")], F.col("_least")).select("doc_id", "quality")


@query(f"""
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {DRAW}, doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT lang, CASE WHEN k / n < 0.8 THEN 'train' WHEN k / n < 0.9 THEN 'validation' ELSE 'test' END AS split, count(*) AS n FROM r GROUP BY 1, 2""")
def stratified_split_counts(spark, sf_dir):
    d = select.stratified_split(table(spark, sf_dir, "documents"), ["lang"], "doc_id", [("train", 0.8), ("validation", 0.1), ("test", 0.1)])
    return d.groupBy("lang", "split").agg(F.count(F.lit(1)).alias("n"))


@query()
def stratified_pick(spark, sf_dir):
    return select.stratified_pick(table(spark, sf_dir, "documents"), ["lang", "source"], "doc_id", 200).select("doc_id", "lang", "source")


@query()
def group_split(spark, sf_dir):
    return select.group_split(table(spark, sf_dir, "documents"), "source", "lang", 0.2).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


PARTS = f"(SELECT doc_id, sha256(lower({KEY})) AS h, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM documents)"


def _parts(spark, sf_dir):
    split = F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train")
    return table(spark, sf_dir, "documents").select("doc_id", context_hash(F.col("text")).alias("h"), split.alias("split"))


@query(f"SELECT doc_id, CASE WHEN bool_or(split = 'train') OVER (PARTITION BY h) THEN 'train' ELSE split END AS split FROM {PARTS}")
def leakage_repair(spark, sf_dir):
    return select.repair_leakage(_parts(spark, sf_dir), "h").select("doc_id", "split")


@query(f"SELECT h, count(DISTINCT split) AS n_splits FROM {PARTS} GROUP BY h HAVING count(DISTINCT split) > 1")
def leaking_groups(spark, sf_dir):
    return select.leaking_groups(_parts(spark, sf_dir), "h")


@query(f"SELECT count(*) AS n_leaks FROM (SELECT h FROM (SELECT h, CASE WHEN bool_or(split = 'train') OVER (PARTITION BY h) THEN 'train' ELSE split END AS split FROM {PARTS}) GROUP BY h HAVING count(DISTINCT split) > 1)")
def split_assertion(spark, sf_dir):
    return select.leaking_groups(select.repair_leakage(_parts(spark, sf_dir), "h"), "h").agg(F.count(F.lit(1)).alias("n_leaks"))


@query("SELECT source, array_to_string(list_filter([CASE WHEN bool_or(doc_id < 20) THEN 'EARLY' END, CASE WHEN bool_or(n_chars > 10000) THEN 'LONG' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents GROUP BY source HAVING bool_or(doc_id < 20) OR bool_or(n_chars > 10000)")
def forced_train_groups(spark, sf_dir):
    f = select.forced_train(table(spark, sf_dir, "documents"), "source", {"EARLY": F.col("doc_id") < 20, "LONG": F.col("n_chars") > 10000})
    return f.select("source", F.array_join("reasons", ",").alias("reasons"))


@query(f"""
WITH p AS {PARTS} SELECT doc_id FROM p WHERE split = 'train' AND h NOT IN (SELECT h FROM p WHERE split = 'validation')""")
def anti_join_heldout(spark, sf_dir):
    p = _parts(spark, sf_dir)
    return joins.pending(p.where("split = 'train'"), p.where("split = 'validation'"), "h").select("doc_id")


@query("SELECT d.doc_id, coalesce(CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unrated') AS rating FROM documents d LEFT JOIN labels USING (doc_id)")
def left_override_merge(spark, sf_dir):
    rated = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("rating"))
    return joins.override(table(spark, sf_dir, "documents").select("doc_id", F.lit("unrated").alias("rating")), rated, "doc_id", "rating")


@query("""
SELECT d.doc_id AS a, e.doc_id AS b FROM documents d JOIN documents e ON e.doc_id = d.doc_id + 1 AND e.lang = d.lang AND e.text <> d.text""")
def residual_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("a"), "lang", F.col("text").alias("ta"))
    b = d.select(F.col("doc_id").alias("b"), (F.col("doc_id") - 1).alias("a"), "lang", F.col("text").alias("tb"))
    return a.join(b, ["a", "lang"]).where("ta <> tb").select("a", "b")


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {DRAW}, doc_id LIMIT 20")
def next_batch(spark, sf_dir):
    rest = joins.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")
    return rest.orderBy(seeded_order(F.col("doc_id")), "doc_id").limit(20).select("doc_id")
