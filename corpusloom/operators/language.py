"""Languages by character trigrams, and documents whose declared language is another one.

A table of log-likelihoods is counted from labelled texts: of each language, how often a trigram of letters (words padded by
spaces) occurs, with one added to every count.  A word's score is the sum over its trigrams and is worked out once for
each distinct word; a document's score is the sum over its word counts.  A table of up to ``MOST_SENT`` rows is sent to every task and sums are made
there, so a document exchanges a row a language; beside a larger one words are counted in each document and then exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import key_text

from .graph import reliable

LEAST_CHARACTERS = 20
#: Rows of a table that is sent to every task at most.
MOST_SENT = 1_000_000
UNKNOWN = "unknown"


def letter_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+"), lambda w: w != "")


def trigrams(word: Column) -> Column:
    """The trigrams of a word padded by a space on both sides."""
    padded = F.concat(F.lit(" "), word, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3)))


def trigram_table(labelled: DataFrame) -> DataFrame:
    """(gram, lang, score) of rows (text, lang): log of the smoothed share; the row with a null gram has the score of unseen ones.

    Rows without a language teach nothing.
    """
    words = labelled.where("lang is not null").select("lang", F.explode(letter_words(F.col("text"))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = words.select("lang", "n", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kinds = counts.agg(F.countDistinct("gram").alias("kinds"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(F.broadcast(kinds))  # a row a language, beside one row
    share = lambda n: F.log((n + 1) / (F.col("total") + F.col("kinds")))
    seen = counts.join(F.broadcast(totals), "lang").select("gram", "lang", share(F.col("n")).alias("score"))
    return seen.unionByName(totals.select(F.lit(None).cast("string").alias("gram"), "lang", share(F.lit(0)).alias("score")))


def detect_languages(docs: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, detected) of every row: the likeliest language of the whole text, the first by name of equal ones.

    Texts below 20 characters or without letters are ``unknown``; so is all with an empty table.  Rows that repeat a key are one text here, so keys should be unique.
    """
    long = docs.where(F.length(key_text(F.col("text"))) >= LEAST_CHARACTERS)
    words = long.select(key, letter_words(F.col("text")).alias("words"))
    table = reliable(table)
    unseen = table.where("gram is null").select("lang", F.col("score").alias("floor"))
    # of a language that lacks a trigram the floor counts: the sum of floors, plus what each seen trigram is above
    above = table.where("gram is not null").join(F.broadcast(unseen), "lang").select("gram", "lang", (F.col("score") - F.col("floor")).alias("gain"))
    if table.count() <= MOST_SENT:
        grams = words.select(key, F.explode("words").alias("word")).select(key, F.explode(trigrams(F.col("word"))).alias("gram"))
        langs = [r["lang"] for r in unseen.collect()]  # a row a language
        wide = above.groupBy("gram").agg(F.count(F.lit(1)).alias("_k"), *[F.coalesce(F.sum(F.when(F.col("lang") == v, F.col("gain"))), F.lit(0.0)).alias(f"g{i}") for i, v in enumerate(langs)])
        sums = grams.join(F.broadcast(wide), "gram").groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"g{i}").alias(f"g{i}") for i in range(len(langs))])
        by_lang = F.array(*[F.struct(F.lit(v).alias("lang"), F.col(f"g{i}").alias("gain")) for i, v in enumerate(langs)])
        gained = sums.select(key, F.inline(by_lang)) if langs else sums.select(key, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("gain"))
    else:
        counted = words.select(key, F.explode("words").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
        grams = counted.select("word").distinct().select("word", F.explode(trigrams(F.col("word"))).alias("gram")).groupBy("word", "gram").agg(F.count(F.lit(1)).alias("times"))
        gains = grams.join(above, "gram").groupBy("word", "lang").agg(F.sum(F.col("times") * F.col("gain")).alias("gain"))
        gained = counted.join(gains, "word").groupBy(key, "lang").agg(F.sum(F.col("n") * F.col("gain")).alias("gain"))
    sizes = words.where(F.size("words") > 0).groupBy(key).agg(F.sum(F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w))).alias("grams"))
    scored = sizes.join(F.broadcast(unseen)).join(gained, [key, "lang"], "left").select(key, "lang", (F.coalesce("gain", F.lit(0.0)) + F.col("grams") * F.col("floor")).alias("score"))
    best = scored.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), "lang"))["lang"].alias("detected"))
    return docs.select(key).join(best, key, "left").select(key, F.coalesce("detected", F.lit(UNKNOWN)).alias("detected"))


def mismatch(detected: Column, declared: Column) -> Column:
    """LANGUAGE_MISMATCH where a detected language differs from a declared one, else null."""
    return F.when((detected != UNKNOWN) & (declared != "") & (detected != declared), "LANGUAGE_MISMATCH")
