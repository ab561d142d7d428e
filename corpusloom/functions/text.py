"""Text normalization and counting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import GROUNDING_GENERIC

BLANKS = r"[ \t\n\x0B\f\r]+"
#: Accented letters of French, German and Spanish and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def clean_text(text: Column) -> Column:
    """Line breaks to LF, no-break spaces to spaces, blanks collapsed within lines, lines and whole trimmed."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]", "\n")
    t = F.regexp_replace(F.translate(t, "\u00a0", " "), r"[ \t]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r" *\n *", "\n"), r"^[ \n]+", "")
    return F.regexp_replace(t, r"[ \n]+$", "")


def key_text(text: Column) -> Column:
    """Text for comparison: every run of blanks is one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def normalized(text: Column) -> Column:
    return F.lower(key_text(text))


def fold_accents(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def fold_term(text: Column) -> Column:
    """Folded, with runs of anything but a-z and 0-9 as one space."""
    return F.trim(F.regexp_replace(fold_accents(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def word_count(text: Column) -> Column:
    t = key_text(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def tokens(text: Column) -> Column:
    return F.filter(F.split(fold_term(text), " "), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def sentence_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]+(?:\s+|$)"), lambda s: F.trim(s) != ""))


def has_repeated_sentence(text: Column) -> Column:
    """Does a sentence of four words or more stand twice, letter case aside."""
    s = F.filter(F.split(F.coalesce(text, F.lit("")), r"[.!?]\s+"), lambda x: word_count(x) >= 4)
    s = F.transform(s, lambda x: F.lower(key_text(x)))
    return F.size(F.array_distinct(s)) < F.size(s)


def grounding(text: Column, context: Column) -> Column:
    """Share of the words of 7 letters or more, generic ones aside, whose first 6 letters stand in the context; 1 without such words."""
    words = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)[a-zà-öø-ÿ]{7,}"), F.lit(0)), F.lower)
    words = F.filter(words, lambda w: ~w.isin(GROUNDING_GENERIC))
    found = F.filter(words, lambda w: F.instr(F.lower(F.coalesce(context, F.lit(""))), F.substring(w, 1, 6)) > 0)
    return F.when(F.size(words) > 0, F.size(found) / F.size(words)).otherwise(F.lit(1.0))


def is_missing(value: Column) -> Column:
    return value.isNull() | F.lower(F.trim(value.cast("string"))).isin("", "nan", "none", "null")


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(F.coalesce(a, F.lit(""))), F.length(F.coalesce(b, F.lit("")))
    return F.greatest(x, y) / F.greatest(F.lit(1), F.least(x, y))


def whole_word(text: Column, term: Column) -> Column:
    """Does the folded term stand in the folded text as whole words (both folded already)."""
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))
