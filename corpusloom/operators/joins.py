"""Key joins, exclusive sides, and text joins by shingles and lexicon terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import fold_term, key_text, tokens

from .graph import reliable

#: Rows that are sent to every task at most.
MOST_SENT = 1_000_000
#: First words of terms that a plan names at most.
MOST_FIRST = 1_000

def override(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``left`` with ``value`` replaced where ``right`` has one."""
    r = right.select(key, F.col(value).alias("_new"))
    return left.join(r, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def exclusive_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))


def compare_edges(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, place) of two sets of undirected edges (a, b): shared, left or right."""
    norm = lambda e, s: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn(s, F.lit(True))
    both = norm(left, "_l").join(norm(right, "_r"), ["a", "b"], "full")
    return both.select("a", "b", F.when(F.col("_l") & F.col("_r"), "shared").when(F.col("_l"), "left").otherwise("right").alias("place"))


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key).distinct(), key, "left_anti")


def shingle_rows(df: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """(key, shingle) distinct word shingles; texts with fewer words have none.

    Words are exploded with their places and joined to windows in sorted order, so no text is split twice.
    """
    return _shingles(df, key, text, width).select(key, F.explode("_s").alias("shingle"))


def _shingles(df: DataFrame, key: str, text: Column, width: int) -> DataFrame:
    """(key, _s): the distinct shingles of each row."""
    words = df.select(key, F.filter(F.split(F.lower(key_text(text)), " "), lambda w: w != "").alias("_w"))
    cut = F.get(F.transform(F.array(F.col("_w")), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - width + 1), lambda i: F.xxhash64(*[F.get(w, i + k - 1) for k in range(width)])))), F.lit(0))
    return words.select(key, F.array_distinct(F.coalesce(cut, F.array().cast("array<bigint>"))).alias("_s"))


def _sent_whole(df: DataFrame) -> DataFrame:
    """``df``, to be sent to every task if it is small, so that the other side of its join is not exchanged."""
    df = reliable(df)
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def containment(left: DataFrame, right: DataFrame, left_key: str, right_key: str, *, width: int = 5, least: float = 0.6) -> DataFrame:
    """(left_key, right_key, shared, containment): shared shingles over the smaller set, at least ``least``.

    Shingles of the right side are sent to every task up to ``MOST_SENT`` of them, so only shared ones of the left are
    exchanged.  Sets are counted for those rows that share one.
    """
    a, b = shingle_rows(left, left_key, F.col("text"), width), _sent_whole(shingle_rows(right, right_key, F.col("text"), width))
    shared = reliable(a.join(b, "shingle").groupBy(left_key, right_key).agg(F.count(F.lit(1)).alias("shared")))
    met = left.join(_sent_whole(shared.select(left_key).distinct()), left_key, "left_semi")
    na = _shingles(met, left_key, F.col("text"), width).groupBy(left_key).agg(F.sum(F.size("_s")).alias("_na"))
    nb = b.groupBy(right_key).agg(F.count(F.lit(1)).alias("_nb"))
    out = shared.join(na, left_key).join(nb, right_key).withColumn("containment", F.col("shared") / F.least("_na", "_nb"))
    return out.where(F.col("containment") >= least).select(left_key, right_key, "shared", "containment")


def lexicon_matches(docs: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """(key, rule_id, term) of lexicon (rule_id, lang, term) terms that stand as whole words in the folded text.

    Terms of n words join on the text's n-grams, so the lexicon may grow; the language must agree.  Up to ``MOST_SENT`` terms are sent
    to every task, and no n-gram is exchanged.
    """
    lex = lexicon.select("rule_id", F.col("lang").alias("_lang"), fold_term(F.col("term")).alias("term")).withColumn("_n", F.size(F.split("term", " ")))
    lex = _sent_whole(lex)
    sizes = lex.select("_n").distinct()
    d = docs.select(key, F.col("lang").alias("_lang"), tokens(F.col("text")).alias("_w"))
    d = d.crossJoin(F.broadcast(sizes))  # a handful of term lengths
    first = [r["w"] for r in lex.select(F.get(F.split("term", " "), F.lit(0)).alias("w")).distinct().limit(MOST_FIRST + 1).collect()]
    # of a few first words it is known where a term can start
    starts = lambda w, i: F.filter(i, lambda k: F.get(w, k - 1).isin(first)) if len(first) <= MOST_FIRST else i
    grams = F.get(F.transform(F.array(F.struct("_w", "_n")), lambda s: F.when(F.size(s["_w"]) >= s["_n"], F.transform(starts(s["_w"], F.sequence(F.lit(1), F.size(s["_w"]) - s["_n"] + 1)), lambda i: F.array_join(F.slice(s["_w"], i, s["_n"]), " ")))), F.lit(0))
    g = d.select(key, "_lang", "_n", F.explode(F.array_distinct(F.coalesce(grams, F.array().cast("array<string>")))).alias("term"))
    return g.join(lex, ["_lang", "_n", "term"]).select(key, "rule_id", "term")


def split_overlap(df: DataFrame, part: str, key: Column) -> DataFrame:
    """(left, right, shared_keys): keys that two parts share."""
    k = df.select(F.col(part).alias("_p"), key.alias("_k")).distinct()
    a, b = k.select(F.col("_p").alias("left"), "_k"), k.select(F.col("_p").alias("right"), "_k")
    return a.join(b, "_k").where(F.col("left") < F.col("right")).groupBy("left", "right").agg(F.count(F.lit(1)).alias("shared_keys"))
