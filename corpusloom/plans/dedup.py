"""Duplicates, text joins and preference graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import fixed_lexicon, text
from corpusloom.functions.fingerprints import context_hash, text_digest
from corpusloom.operators import graph, joins, lexicon, window

from .audit import KEY
from .registry import query, table

NORM = f"lower({KEY})"


@query(f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def keep_first_dedup(spark, sf_dir):
    return window.keep_first(table(spark, sf_dir, "documents"), [context_hash(F.col("text"))], [F.col("doc_id")]).select("doc_id", "lang")


@query(f"""
WITH g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {KEY}) AS group_id FROM documents)
SELECT group_size, count(*) AS n_groups FROM (SELECT group_id, count(*) AS group_size FROM g GROUP BY 1) GROUP BY 1""")
def exact_group_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text_digest(F.col("text")).alias("h"))
    groups = graph.group_ids(d.select(F.col("doc_id").alias("node")), graph.key_edges(d, "doc_id", ["h"]))
    return graph.size_distribution(groups)


@query(f"""
WITH k AS (SELECT DISTINCT doc_id % 10 AS p, sha256({NORM}) AS h FROM documents)
SELECT a.p AS "left", b.p AS "right", count(*) AS shared_keys FROM k a JOIN k b ON a.h = b.h AND a.p < b.p GROUP BY 1, 2""")
def cross_split_overlap(spark, sf_dir):
    return joins.split_overlap(table(spark, sf_dir, "documents").withColumn("part", F.col("doc_id") % 10), "part", context_hash(F.col("text")))


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def two_sided_id_diff(spark, sf_dir):
    return joins.exclusive_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT doc_id FROM labels")
def pool_intersection(spark, sf_dir):
    return joins.shared_keys(table(spark, sf_dir, "documents").where("doc_id % 3 = 0"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH l AS (SELECT DISTINCT least(o_custkey, o_orderkey % 100) AS a, greatest(o_custkey, o_orderkey % 100) AS b FROM orders),
r AS (SELECT DISTINCT least(o_custkey, o_orderkey % 50) AS a, greatest(o_custkey, o_orderkey % 50) AS b FROM orders)
SELECT coalesce(l.a, r.a) AS a, coalesce(l.b, r.b) AS b, CASE WHEN l.a IS NULL THEN 'right' WHEN r.a IS NULL THEN 'left' ELSE 'shared' END AS place FROM l FULL JOIN r ON l.a = r.a AND l.b = r.b""")
def edge_set_compare(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    edges = lambda m: o.select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % m).alias("b"))
    return joins.compare_edges(edges(100), edges(50))


WORDS = f"list_filter(string_split({NORM}, ' '), lambda x: x <> '')"


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, w[i:i + 4] AS s FROM d, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, w[i:i + 4] AS s FROM b, unnest(range(1, len(w) - 3)) t(i) WHERE len(w) >= 5),
nd AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1),
j AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN bs USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, shared, shared / least(nd.n, nb.n) AS containment FROM j JOIN nd USING (doc_id) JOIN nb USING (item_id) WHERE shared / least(nd.n, nb.n) >= 0.6""")
def containment_vs_benchmark(spark, sf_dir):
    return joins.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(f"""
WITH t AS (SELECT conv_id, turn, list_distinct({WORDS}) AS w FROM conversations WHERE role <> 'system')
SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS similarity FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.w || b.w) > 0""")
def turn_jaccard(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    w = F.array_distinct(F.filter(F.split(text.normalized(F.col("text")), " "), lambda x: x != ""))
    a = c.select("conv_id", "turn", w.alias("w"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), w.alias("v"))
    return a.join(b, ["conv_id", "turn"]).where(F.size("w") + F.size("v") > 0).select("conv_id", "turn", text.jaccard(F.col("w"), F.col("v")).alias("similarity"))


@query(f"""
WITH k AS (SELECT doc_id, source, length(text) // 100 AS bucket, {NORM} AS t, length(text) AS n FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source, bucket ORDER BY t, doc_id) AS rn FROM k)
SELECT a.doc_id AS "left", b.doc_id AS "right" FROM r a JOIN r b ON a.source = b.source AND a.bucket = b.bucket AND b.rn BETWEEN a.rn + 1 AND a.rn + 5 AND a.t = b.t""")
def sorted_neighbourhood_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.floor(F.length("text") / 100).alias("bucket"), text.normalized(F.col("text")).alias("t"))
    pairs = window.look_ahead_pairs(d, ["source", "bucket"], ["t", "doc_id"], "doc_id")
    head = d.select("doc_id", F.sha2("t", 256).alias("head"))
    j = pairs.join(head.select(F.col("doc_id").alias("left"), F.col("head").alias("h1")), "left").join(head.select(F.col("doc_id").alias("right"), F.col("head").alias("h2")), "right")
    return j.where("h1 = h2").select("left", "right")


LEXICON = [
    ("R1", "en", "the of"), ("R1", "fr", "de la"), ("R2", "en", "and the"), ("R2", "de", "und der"), ("R3", "es", "de los"), ("R3", "en", "not"), ("R4", "fr", "les"),
    ("R5", "en", "with that"), ("R5", "fr", "Dans, pour"), ("R6", "en", "from this that with"), ("R6", "en", "pain"), ("R7", "fr", "froid"), ("R7", "en", "Red"), ("R8", "fr", "été"), ("R8", "de", "für"), ("R9", "en", "that"), ("R9", "es", "para"),
]
LEX = "(VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in LEXICON) + ") l(rule_id, lang, term)"


def _bare(text):
    return f"lower(strip_accents(replace(replace({text}, 'ß', 'ss'), 'ẞ', 'ss')))"


def _folded(text, others="[^a-z0-9]+"):
    return f"trim(regexp_replace({_bare(text)}, '{others}', ' ', 'g'))"


def _lexicon(spark):
    return spark.createDataFrame(LEXICON, "rule_id string, lang string, term string")


GENERIC = " OR ".join(f"(lang = '{k}' AND t IN ({', '.join(repr(t) for t in v)}))" for k, v in fixed_lexicon.GENERIC_TERMS.items())
MOTIFS = f"""(SELECT doc_id, rule_id, x.t AS term FROM (SELECT doc_id, lang, ' ' || {_folded('text')} || ' ' AS body FROM documents) d
  JOIN (SELECT DISTINCT rule_id, lang, {_folded('term')} AS t FROM {LEX}) x ON x.lang = d.lang WHERE contains(body, ' ' || x.t || ' ') AND NOT ({GENERIC.replace("lang", "x.lang").replace(" t ", " x.t ")}))"""


@query(f"SELECT doc_id, rule_id, term FROM {MOTIFS}")
def lexicon_match(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(lexicon.language_motifs(_lexicon(spark), F.col("text"), F.col("lang"))).alias("m"))
    return d.select("doc_id", "m.rule_id", F.explode("m.matched_terms").alias("term"))


@query(f"""
WITH t AS (SELECT doc_id, rule_id, max(length(term)) AS longest, string_agg(term, ',' ORDER BY length(term) DESC, term) AS terms FROM {MOTIFS} GROUP BY doc_id, rule_id)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY longest DESC, rule_id) AS place, rule_id, terms FROM t""")
def lexicon_candidate_order(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lexicon.language_motifs(_lexicon(spark), F.col("text"), F.col("lang"))).alias("p", "m"))
    return d.select("doc_id", (F.col("p") + 1).cast("long").alias("place"), "m.rule_id", F.array_join("m.matched_terms", ",").alias("terms"))


WORD_OTHERS = r"[^\p{L}\p{N}_]+"
SCORED_GENERIC = ", ".join(repr(t) for t in fixed_lexicon.SCORED_GENERIC_TERMS)
SCORES = f"""
WITH x AS (SELECT DISTINCT rule_id, t, list_filter(string_split(t, ' '), lambda w: length(w) >= 4) AS w FROM (SELECT rule_id, {_folded('term', WORD_OTHERS)} AS t FROM {LEX}) WHERE t NOT IN ({SCORED_GENERIC})),
f AS (SELECT doc_id, {_folded("text || ' ' || string_split(text, chr(10))[1] || ' ' || coalesce(source, '')", WORD_OTHERS)} AS body, {_folded("string_split(text, chr(10))[1]", WORD_OTHERS)} AS f1, {_folded("coalesce(source, '')", WORD_OTHERS)} AS f2 FROM documents),
b AS (SELECT doc_id, unnest([body, f1, f2]) AS v, unnest([0, 1, 2]) AS k FROM f),
v AS (SELECT doc_id, k, ' ' || v || ' ' AS v, string_split(v, ' ') AS ws FROM b),
s AS (SELECT doc_id, k, rule_id, t, CASE WHEN contains(v, ' ' || t || ' ') THEN 2.0 WHEN len(w) >= 2 AND len(list_filter(w, lambda q: list_contains(ws, q))) >= 0.75 * len(w) THEN 1.0 ELSE 0 END AS score FROM v, x),
m AS (SELECT doc_id, rule_id, sum(score) FILTER (k = 0) + 0.5 * count(DISTINCT k) FILTER (k > 0) AS score, string_agg(t, ',' ORDER BY t) FILTER (k = 0) AS terms, count(DISTINCT k) FILTER (k > 0) AS n_fields FROM s WHERE score > 0 GROUP BY doc_id, rule_id),
r AS (SELECT *, row_number() OVER w AS place, lead(score, 1, 0) OVER w AS nxt FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, rule_id)),
o AS (SELECT d.doc_id, CASE WHEN score IS NULL THEN 'no_match' WHEN score < 2 THEN 'weak_match' WHEN score - nxt < 1 THEN 'ambiguous_match' ELSE 'unique_match' END AS status, coalesce(score, 0)::DOUBLE AS best_score, coalesce(score - nxt, 0)::DOUBLE AS margin,
  rule_id AS best, terms, n_fields FROM documents d LEFT JOIN (SELECT * FROM r WHERE place = 1) b ON b.doc_id = d.doc_id)"""


def _recovered(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fields = {"first_line": F.get(F.split("text", "\n"), F.lit(0)), "source": F.col("source")}
    return d.select("doc_id", lexicon.resolved(lexicon.scored_rules(_lexicon(spark), F.col("text"), fields)).alias("m"))


@query(f"{SCORES} SELECT * FROM o")
def lexicon_best_margin(spark, sf_dir):
    best = F.get("m.candidates", F.lit(0))
    return _recovered(spark, sf_dir).select("doc_id", "m.status", F.col("m.score").alias("best_score"), "m.margin", best["rule_id"].alias("best"), F.array_join(best["matched_terms"], ",").alias("terms"), F.when(best.isNotNull(), F.size(best["structured_hits"]).cast("long")).alias("n_fields"))


@query(f"""{SCORES} SELECT count_if(status = 'no_match') AS no_match, count_if(status = 'weak_match') AS weak_match, count_if(status = 'ambiguous_match') AS ambiguous_match, count_if(status = 'unique_match') AS unique_match,
  count_if(status = 'unique_match' AND n_fields > 0) AS unique_with_fields, count_if(status = 'unique_match' AND n_fields = 0) AS unique_by_text FROM o""")
def recovery_counts(spark, sf_dir):
    return _recovered(spark, sf_dir).agg(*lexicon.recovery_counts(F.col("m")))


@query(f"SELECT doc_id, rule_id, t AS term FROM (SELECT doc_id, lang, ' ' || {_folded('text')} || ' ' AS body FROM documents) d JOIN (SELECT DISTINCT rule_id, lang, {_folded('term')} AS t FROM {LEX}) x ON x.lang = d.lang WHERE contains(body, ' ' || t || ' ')".replace("'ss'", "' '"))
def lexicon_match_by_join(spark, sf_dir):
    return joins.lexicon_matches(table(spark, sf_dir, "documents"), _lexicon(spark), "doc_id").distinct()


PREFS = "(SELECT o_custkey AS prompt, o_orderkey % 5 AS chosen, (o_orderkey // 5) % 5 AS rejected FROM orders WHERE o_orderkey % 5 <> (o_orderkey // 5) % 5)"


def preferences(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("prompt"), (F.col("o_orderkey") % 5).alias("chosen"), (F.floor(F.col("o_orderkey") / 5) % 5).alias("rejected"))
    return o.where("chosen <> rejected")


@query(f"SELECT DISTINCT a.prompt, a.chosen AS a, a.rejected AS b FROM {PREFS} a JOIN {PREFS} b ON a.prompt = b.prompt AND a.chosen = b.rejected AND a.rejected = b.chosen WHERE a.chosen < a.rejected")
def preference_inversions(spark, sf_dir):
    return graph.inversions(preferences(spark, sf_dir))


@query(f"SELECT prompt, count(*) AS n_answers FROM (SELECT prompt, x FROM (SELECT prompt, chosen AS x, 1 AS role FROM {PREFS} UNION ALL SELECT prompt, rejected, 2 FROM {PREFS}) GROUP BY prompt, x HAVING count(DISTINCT role) > 1) GROUP BY prompt")
def role_conflicts(spark, sf_dir):
    return graph.role_changes(preferences(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT prompt, chosen, rejected FROM {PREFS}),
p AS (SELECT prompt, chosen AS root, rejected AS node FROM e UNION SELECT p.prompt, p.root, e.rejected FROM p JOIN e ON e.prompt = p.prompt AND e.chosen = p.node)
SELECT DISTINCT prompt FROM p WHERE root = node""")
def preference_cycles(spark, sf_dir):
    return graph.cyclic_groups(preferences(spark, sf_dir))


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT doc_id AS a, item_id + 10000000 AS b FROM ({{CONTAIN}}) c),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS node FROM u),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node, min(seen) AS group_id FROM r GROUP BY node""".replace("{CONTAIN}", "@"))
def benchmark_groups(spark, sf_dir):
    c = graph.reliable(containment_vs_benchmark(spark, sf_dir))
    e = c.select(F.col("doc_id").alias("a"), (F.col("item_id") + 10000000).alias("b"))
    return graph.group_ids(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), e)


from .registry import SQL  # noqa: E402

SQL["benchmark_groups"] = SQL["benchmark_groups"].replace("@", SQL["containment_vs_benchmark"])
