"""Benchmark decontamination by winnowing, in Spark expressions only.

A text's fingerprints are the least hashes of its sliding windows: hashes of ``gram`` consecutive
words, of which each window of ``window`` words (that is ``window - gram + 1`` grams) keeps the least.  Equal
windows keep equal hashes, so every shared span of ``window`` words or more shares a fingerprint:
none is missed.  Training and test fingerprints are joined, each hit is extended to the windows that kept
it, and these are held against the items' windows word by word.

Fingerprints are kept as runs: neighbouring windows mostly keep the same hash.  A document's runs are
exploded, only those with a fingerprint of the benchmark stay, and only documents that have
such runs are read again for their words.  The benchmark is broadcast while it has at most
``MOST_PRINTS`` fingerprints; beyond that it is joined by an exchange of hashes and places, never of texts.
Windows that several items share are one window with a set of items; what a set of windows means is
worked out once, not once a document.

Items of fewer words than a window are one window of all their words; documents get the grams of just
these lengths (at most ``window - 1`` of them) besides.

Defined results: null and wordless texts have no words and are hit by nothing; null and wordless items have no window; item
rows that repeat an id are one item with the windows of all; items without an id are one item that is counted but
not listed; rows that repeat a document, or have no doc_id, are judged each by their text; an empty benchmark hits nothing; ties
between equal hashes are equal fingerprints; extra columns are ignored.  Of a very long text a task holds
its words and one hash for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Between words: all ASCII characters but letters and digits (upper-case letters are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the benchmark's fingerprints, of its windows, or of the runs found, that are broadcast at most: some tens of MB.
MOST_PRINTS = 1_000_000
#: Marks the one row that each document has beside its runs.
HEAD = -1


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def slid(df: DataFrame, out: str, values: str, width: int, step: Callable[..., Column]) -> DataFrame:
    """``df`` with ``out``: ``step`` over every ``width`` consecutive values of the array ``values``, by doubling.

    Each doubling is a projection of its own, so that no array is computed twice.  (What is exploded later has to be
    exploded with ``explode_outer``: of a plain one the optimizer pushes the array's size, spelled out, below all of them.)
    """
    df, reach = df.withColumn(out, F.col(values)), 1
    while reach < width:
        more = min(reach, width - reach)
        df = df.withColumn(out, F.zip_with(out, F.slice(out, more + 1, F.greatest(F.size(out) - more, F.lit(0))), lambda a, b: step(a, b)))
        reach += more
    return df.withColumn(out, F.slice(out, 1, F.greatest(F.size(out) - (width - 1), F.lit(0))))


def with_runs(df: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """``df`` (with ``words``) with ``runs``: print, first and last start of the windows that keep it, words of such a window."""
    carried = [c for c in df.columns if c != "words"]
    df = df.select(*carried, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    df = slid(df, "g", "h", gram, F.xxhash64)
    df = slid(df, "m", "g", window - gram + 1, F.least)
    for n in short:
        df = slid(df, f"g{n}", "h", n, F.xxhash64)
    df = df.withColumn("s", F.when(F.size("m") > 0, F.filter(F.sequence(F.lit(0), F.size("m") - 1), lambda i: ~F.get("m", i).eqNullSafe(F.get("m", i - 1)))).otherwise(F.array().cast("array<int>")))
    run = lambda h, a, b, n: F.struct(h.alias("print"), a.alias("first"), b.alias("last"), F.lit(n).alias("size"))
    runs = [F.transform("s", lambda i, j: run(F.get("m", i), i, F.coalesce(F.get("s", j + 1), F.size("m")) - 1, window))]
    every = lambda n: F.transform(f"g{n}", lambda h, i: run(h, i, i, n))
    runs += [every(n) for n in short]
    return df.select(*carried, F.concat(*runs).alias("runs"))


def _sized(df: DataFrame, rows: str = "1") -> DataFrame:
    """A computed table, to be broadcast if the sum of ``rows`` over it is small."""
    n = df.agg(F.expr(f"sum({rows})")).first()[0] or 0
    return F.broadcast(df) if n <= MOST_PRINTS else df


def _item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """words, window text, size and item of every window of the items."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("size", F.least(F.size("words"), F.lit(window)))
    rows = items.select("item", "words", "size", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("at"))
    return rows.select("item", "size", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("window"))


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 7, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence of an item's window), n_items, items (their ids as strings,
    sorted; with ``digest`` items_sha256 of them, comma-joined) and contaminated of every row of ``docs``."""
    if not 0 < gram <= window:
        raise ValueError("a gram has at least one word and at most those of a window")
    windows = materialize(_item_windows(benchmark, window).groupBy("window", "size").agg(F.array_sort(F.collect_set("item")).alias("held")))
    windows = materialize(windows.select("window", "size", F.md5(F.array_join("held", ",")).alias("holders"), "held"))
    short = sorted(r["size"] for r in windows.where(F.col("size") < window).select("size").distinct().collect())  # fewer than ``window`` numbers
    shown = windows.select(F.split("window", " ").alias("words"), F.col("size").alias("words_size"))
    prints = with_runs(shown, window, gram, short).select("words_size", F.explode_outer("runs").alias("r")).where("words_size = r.size")
    prints = _sized(materialize(prints.select("r.print", "r.size").distinct()))

    content = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("c1"), F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("c2")]
    read = docs.select(F.col("doc_id").alias("doc"), *content, words_of(F.col("text")).alias("words"))
    runs = with_runs(read.withColumn("n_words", F.size("words").cast("long")), window, gram, short)
    head = F.struct(F.col("c1").alias("print"), F.lit(HEAD).alias("first"), F.lit(HEAD).alias("last"), F.lit(0).alias("size"))
    rows = runs.select("doc", "c1", "c2", "n_words", F.explode_outer(F.concat(F.array(head), "runs")).alias("r")).select("doc", "c1", "c2", "n_words", "r.*")
    met = materialize(rows.join(prints.withColumn("met", F.lit(True)), ["print", "size"], "left").where((F.col("first") == HEAD) | F.col("met")).drop("print", "met"))

    # extend: the windows of each run, of one row of each text
    hits = materialize(met.where(F.col("first") != HEAD).groupBy("c1", "c2").agg(F.min("doc").alias("one"), F.collect_set(F.struct("first", "last", "size")).alias("spans")))
    texts = docs.select(F.col("doc_id").alias("doc"), *content, "text").join(_sized(hits, "size(spans)"), ["c1", "c2"]).where(F.col("doc").eqNullSafe(F.col("one")))
    spans = texts.select("c1", "c2", words_of(F.col("text")).alias("words"), "spans").select("c1", "c2", "words", F.explode("spans").alias("s"))
    starts = spans.select("c1", "c2", "words", "s.size", F.explode(F.sequence("s.first", "s.last")).alias("at"))
    tried = starts.select("c1", "c2", "at", "size", F.array_join(F.slice("words", F.col("at") + 1, F.col("size")), " ").alias("window"))
    found = tried.join(_sized(windows.select("window", "size", "holders")), ["window", "size"]).select("c1", "c2", "at", (F.col("at") + F.col("size")).alias("end"), "holders")
    by_text = found.groupBy("c1", "c2").agg(F.collect_set(F.struct("at", "end")).alias("hit"), F.collect_set("holders").alias("holders"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))
    add = lambda a, x: F.struct((a["n"] + F.greatest(x["end"] - F.greatest(x["at"], a["reach"]), F.lit(0))).alias("n"), F.greatest(x["end"], a["reach"]).alias("reach"))
    by_text = materialize(by_text.select("c1", "c2", F.aggregate(F.array_sort("hit"), zero, add)["n"].alias("n_hit"), F.array_sort("holders").alias("holders")))

    # each set of windows' holders is spelled out once
    holders = by_text.select("holders").distinct().select("holders", F.explode("holders").alias("holder"))
    sets = windows.select(F.col("holders").alias("holder"), "held").dropDuplicates(["holder"])
    listed = holders.join(sets, "holder").select("holders", F.explode("held").alias("item")).groupBy("holders").agg(F.collect_set("item").alias("items"))
    named = F.array_sort(F.array_remove("items", ""))
    listed = listed.select("holders", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(named, ","), 256).alias("items_sha256") if digest else named.alias("items"))
    known = materialize(by_text.join(listed, "holders").drop("holders"))
    none = F.sha2(F.lit(""), 256).alias("items_sha256") if digest else F.array().cast("array<string>").alias("items")
    shown = "items_sha256" if digest else "items"
    heads = met.where(F.col("first") == HEAD).select("doc", "c1", "c2", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return heads.join(known, ["c1", "c2"], "left").select(F.col("doc").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce(shown, none).alias(shown), (n_hit > 0).alias("contaminated"))
