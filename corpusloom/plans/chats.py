"""Records and messages: assembly and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fingerprints, records

from .registry import query, table


@query("SELECT conv_id, max_by(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant_turn(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return c.select("conv_id", records.last_assistant(F.col("m")).alias("answer")).where("answer is not null")


@query(r"""
SELECT doc_id, concat_ws(chr(10) || chr(10), nullif(trim(source), ''), nullif(trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')), '')) AS input,
  concat_ws('_', upper(lang), 'P' || (doc_id % 3 + 1)) AS category, doc_id % 3 + 1 AS priority FROM documents""")
def chat_assembly(spark, sf_dir):
    p = F.concat(F.lit("P"), (F.col("doc_id") % 3 + 1).cast("string"))
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", records.assemble_input(F.col("source"), F.col("text")).alias("input"), F.concat_ws("_", F.upper("lang"), p).alias("category"), records.priority_number(p).alias("priority"))


@query(r"""
SELECT p_partkey, 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type AS rendered, 'name: ' || p_name || chr(10) || 'size: ' || p_size AS lines,
  2 + CASE WHEN p_size > 25 THEN 2 ELSE 0 END AS richness, CASE WHEN p_size > 25 THEN 'medium' ELSE 'weak' END AS level FROM part""")
def rendered_choices(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    some = lambda c: F.when(F.col("p_size") > 25, F.col(c))
    n, level = records.richness([F.col("p_name"), F.col("p_brand"), some("p_type"), some("p_size")])
    choices = records.choices_map([F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.lit(""), F.lit(None).cast("string")])
    return p.select("p_partkey", records.assemble_input(F.lit(""), F.lit(None).cast("string"), choices).alias("rendered"), records.labelled_lines({"name": F.col("p_name"), "empty": F.lit(""), "size": F.col("p_size")}).alias("lines"), n.alias("richness"), level.alias("level"))


@query(r"""
SELECT doc_id, (doc_id % 4)::INTEGER AS priority_raw, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 4)::INTEGER END AS priority, source AS explanation FROM documents""")
def completion_parsing(spark, sf_dir):
    k = (F.col("doc_id") % 4).cast("int")
    t = F.concat(F.lit("<think>\nPRIORITY: P3\n</think>PRIORITY: P"), k.cast("string"), F.lit("\nEXPLANATION: "), F.col("source"), F.lit("<|im_end|>rest"))
    p, e = records.parse_completion(t)
    return table(spark, sf_dir, "documents").select("doc_id", k.alias("priority_raw"), p.alias("priority"), e.alias("explanation"))


@query("""
SELECT conv_id, turn, branch, content FROM (SELECT conv_id, turn, unnest(['prompt', 'chosen']) AS branch, unnest([u, a]) AS content FROM (
  SELECT u.conv_id, u.turn, u.text AS u, a.text AS a FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'))""")
def branch_explosion(spark, sf_dir):
    from .quality import question_answers

    b = F.explode(F.array(F.struct(F.lit("prompt").alias("branch"), F.col("question").alias("content")), F.struct(F.lit("chosen").alias("branch"), F.col("answer").alias("content")))).alias("b")
    return question_answers(spark, sf_dir).select("conv_id", "turn", b).select("conv_id", "turn", "b.*")


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(p_brand, '[A-E]'))), ',') AS lenient, coalesce(nullif(trim(p_name), ''), 'part:' || p_partkey) AS source_id, p_type AS placeholder FROM part""")
def label_parsing(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(F.array_sort(records.lenient_labels(F.regexp_replace("p_brand", "[a-z]", ""))), ",").alias("lenient"), records.source_id(F.col("p_name"), F.lit("part"), F.col("p_partkey")).alias("source_id"), records.drop_placeholder(F.col("p_type")).alias("placeholder"))


@query("""SELECT doc_id, substr(sha1('pair:' || doc_id), 1, 24) AS pair_id, sha256(array_to_string(list_sort([lang, source]), '␟')) AS unordered FROM documents""")
def pair_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fingerprints.pair_id("pair", F.col("doc_id")).alias("pair_id"), fingerprints.unordered_pair(F.col("lang"), F.col("source")).alias("unordered"))


@query("""SELECT event_id, (props->>'$.k')::INTEGER AS k, event_type FROM events""")
def json_event_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type")


RECOMMEND = {("en", 1): "call now", ("en", 2): "see a doctor today", ("fr", 1): "appelez", ("fr", 2): "consultez"}


@query("SELECT doc_id, r.text AS recommendation FROM documents d LEFT JOIN (VALUES " + ", ".join(f"('{a}', {b}, '{t}')" for (a, b), t in RECOMMEND.items()) + ") r(lang, priority, text) ON r.lang = d.lang AND r.priority = d.doc_id % 3 + 1")
def recommendation_lookup(spark, sf_dir):
    r = spark.createDataFrame([(a, b, t) for (a, b), t in RECOMMEND.items()], "lang string, priority long, recommendation string")
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 3 + 1).alias("priority"))
    return d.join(F.broadcast(r), ["lang", "priority"], "left").select("doc_id", "recommendation")
