"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, fim, langid, mixing, pieces, quality_rules, simhash, substring, suffix, urls, vectors


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where the public vocabulary of the piece model lies; any SentencePiece BPE model will do.
PIECE_MODEL = os.environ.get("CORPUSLOOM_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_table(spark, sf_dir, "documents"), pieces.PieceModel.load(PIECE_MODEL), ["doc_id"])


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"), width=3, seed=42, distance=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify_languages(docs, langid.fit(docs), ["doc_id"])
    held_out = F.coalesce(F.crc32(F.col("carried.doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("carried.doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(extra)))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=200, digest=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("source")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeated_windows(_table(spark, sf_dir, "documents"), window=20, digest=True)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10, digest=True)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle_digests(fim.fill_in_middle(_table(spark, sf_dir, "documents"), rate=50, spm=80, seed=42))


#: The vocabulary of the byte-level tokenizer.
BYTE_MODEL = os.environ.get("CORPUSLOOM_BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")


def op13_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = align.align_documents(_table(spark, sf_dir, "documents"), align.Tokenizers(BYTE_MODEL, PIECE_MODEL), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('7|' || coalesce(doc_id::VARCHAR, '')) AS draw FROM documents),
e AS (SELECT *, ('0x' || substr(draw, 1, 8))::BIGINT % greatest(32, ceil(count(*) OVER (PARTITION BY source) / 200000))::BIGINT AS shard FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM e GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(place - 1) % 3 + 1]::DOUBLE AS weight FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size / weight AS room,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(2.0::DOUBLE * sum(source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT coalesce((SELECT level FROM l WHERE room > level ORDER BY room, place LIMIT 1), (SELECT max(room) FROM l)) AS level),
t AS (SELECT l.source, source_size, least(2.0::DOUBLE * source_size, lev.level * weight) AS target FROM l, lev),
n AS (SELECT round(sum(target) / 4)::BIGINT AS seats, sum(target) AS total, count(*) AS k FROM t),
q1 AS (SELECT t.source, t.target, unnest(range(greatest(1, floor(target / total * seats)::BIGINT - k - 3), floor(target / total * seats)::BIGINT + k + 4)) AS seat, greatest(0, floor(target / total * seats)::BIGINT - k - 4) AS base FROM t, n WHERE target > 0),
r1 AS (SELECT source, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, source NULLS LAST, seat) AS rank FROM q1),
u AS (SELECT source, count(*) AS won FROM r1 WHERE rank <= (SELECT seats FROM n) - (SELECT sum(base) FROM (SELECT DISTINCT source, base FROM q1)) GROUP BY source),
blocks AS (SELECT t.source, t.source_size, t.target, coalesce(u.won, 0) + coalesce(b.base, 0) AS blocks
  FROM t LEFT JOIN u ON t.source IS NOT DISTINCT FROM u.source
  LEFT JOIN (SELECT DISTINCT source, base FROM q1) b ON t.source IS NOT DISTINCT FROM b.source),
c AS (SELECT e.source, e.shard, sum(e.size)::BIGINT AS ring, any_value(b.source_size) AS source_size, any_value(b.target) AS target, any_value(b.blocks) AS blocks
  FROM e JOIN blocks b ON e.source IS NOT DISTINCT FROM b.source GROUP BY e.source, e.shard),
c2 AS (SELECT *, sum(ring) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS k FROM c),
q2 AS (SELECT source, shard, ring, blocks, greatest(0, floor(ring / total * blocks)::BIGINT - k - 4) AS base,
  unnest(range(greatest(1, floor(ring / total * blocks)::BIGINT - k - 3), floor(ring / total * blocks)::BIGINT + k + 4)) AS seat FROM c2 WHERE ring > 0),
b2 AS (SELECT source, sum(base) AS given FROM (SELECT DISTINCT source, shard, base FROM q2) GROUP BY source),
r2 AS (SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY ring::DOUBLE / (2 * seat - 1) DESC, shard, seat) AS rank FROM q2),
v AS (SELECT r2.source, r2.shard, count_if(rank <= blocks - given) AS won FROM r2 JOIN b2 ON r2.source IS NOT DISTINCT FROM b2.source GROUP BY r2.source, r2.shard),
cq AS (SELECT c.*, coalesce(v.won, 0) + coalesce(x.base, 0) AS quota FROM c
  LEFT JOIN v ON c.source IS NOT DISTINCT FROM v.source AND c.shard = v.shard
  LEFT JOIN (SELECT DISTINCT source, shard, base FROM q2) x ON c.source IS NOT DISTINCT FROM x.source AND c.shard = x.shard),
ct AS (SELECT *, CASE WHEN target >= 2.0::DOUBLE * source_size THEN 2 * ring ELSE least(quota * 4, 2 * ring) END AS take,
  ('0x' || substr(md5('7|' || coalesce(source, '') || '|' || shard), 1, 8))::BIGINT AS f FROM cq),
ca AS (SELECT *, CASE WHEN ring > 0 THEN take // ring ELSE 0 END AS rounds, CASE WHEN ring > 0 THEN f * 4 % ring ELSE 0 END AS start FROM ct),
p AS (SELECT doc_id, source, shard, size, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS b FROM e)
SELECT p.doc_id, p.size, ca.source_size::BIGINT AS source_size, ca.target,
  (rounds * size
   + greatest(0, least(b, start + take - rounds * ring) - greatest(b - size, start))
   + greatest(0, least(b, start + take - rounds * ring - ring) - greatest(b - size, start - ring)))::BIGINT AS taken
FROM p JOIN ca ON p.source IS NOT DISTINCT FROM ca.source AND p.shard = ca.shard
"""

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_chat_format": op5_chat_format,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_mix_sources": op7_mix_sources,
    "op8_quality_rules": op8_quality_rules,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_decontaminate": op11_decontaminate,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_align_tokenizers": op13_align_tokenizers,
}
OP10_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM p),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM g WHERE k > 1),
n AS (SELECT doc_id, count(*) AS n_removed, list(j) AS js FROM gone GROUP BY doc_id),
e AS (SELECT d.doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d WHERE len(w) > 0),
k AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.j) AS kept FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.j = e.j WHERE gone.j IS NULL GROUP BY e.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

OP9_SQL = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.a AS vec_id, any_value(coalesce(n.n, 0))::BIGINT AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a
"""

OP11_SQL = r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (
  SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT dw.r, dw.n, dw.s, iw.item FROM dw JOIN iw ON dw.x = iw.x AND dw.n = iw.n),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS j FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) FILTER (item <> '') AS list FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.r = hit.r LEFT JOIN items ON d.r = items.r
"""

OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""

ORACLE_SQL = {"op11_decontaminate": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op9_vector_dedup": OP9_SQL, "op7_mix_sources": OP7_SQL, "op10_substring_dedup": OP10_SQL}
