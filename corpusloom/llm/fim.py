"""Fill-in-the-middle by escaped marker injection, in Spark expressions.

A delimiter is escaped in the text, ``regexp_replace`` appends it after every unit (a word with the white space before
it, or white space alone), counting it counts the units, ``substring_index`` takes prefix, middle and suffix by rank, and the
parts lose the delimiter and the escapes before they are assembled.  Escapes are no white space, so the units of the escaped
text are those of the text.

The two cuts and the two choices of a document come from the first four 8-digit groups of the SHA-256 of ``seed:doc_id``, so they do not
depend on order, partitions or reruns.

Defined results: a null text is empty; empty texts, and texts that hold one of the markers, stay plain; a null doc_id counts
as an empty string in the draw; rows that repeat an id get the same draw, each for its text; cuts may coincide or lie at an end, so that parts
may be empty; extra columns are ignored.  A row's text is held a few times over by its task, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The delimiter, and the escape with its two spellings.
CUT, ESCAPE, OF_ESCAPE, OF_CUT = "\x02", "\x01", "\x01e", "\x01c"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(OF_ESCAPE)), F.lit(CUT), F.lit(OF_CUT))


def _part(marked: Column) -> Column:
    plain = F.replace(marked, F.lit(CUT), F.lit(""))
    return F.replace(F.replace(plain, F.lit(OF_CUT), F.lit(CUT)), F.lit(OF_ESCAPE), F.lit(ESCAPE))


def _index(text: Column, delimiter: str, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(delimiter), count)


def fill_in_middle(docs: DataFrame, *, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output of every row.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these put the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce("text", F.lit(""))
    held = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | held | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", form.alias("form"), F.regexp_replace(_escaped(F.col("text")), UNIT, "$1" + CUT).alias("marked"))
    rows = rows.withColumn("n", F.length("marked") - F.length(F.replace("marked", F.lit(CUT), F.lit(""))))
    rows = rows.withColumn("a", (h[0] % (F.col("n") + 1)).cast("int")).withColumn("b", (h[1] % (F.col("n") + 1)).cast("int"))
    rows = rows.select("doc_id", "text", "form", "marked", "n", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    moved = F.col("form") != "plain"
    to_b = _index(F.col("marked"), CUT, F.col("b"))
    parts = [
        F.when(moved, _part(_index(F.col("marked"), CUT, F.col("a")))).alias("prefix"),
        F.when(moved, _part(_index(to_b, CUT, F.col("a") - F.col("b")))).alias("middle"),
        F.when(moved, _part(_index(F.col("marked"), CUT, F.col("b") - F.col("n") - 1))).alias("suffix"),
    ]
    rows = rows.select("doc_id", "n", "form", "text", *parts)
    out = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", F.col("n").cast("long").alias("n"), "form", "prefix", "middle", "suffix", out.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form stands for."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )


def fill_in_middle_digests(rows: DataFrame) -> DataFrame:
    """The lengths and digests of ``fill_in_middle``'s rows, and of the texts restored from outputs."""
    return rows.select(
        "doc_id", "n", "form",
        F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
