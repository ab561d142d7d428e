"""Personal data: pattern recognizers, redaction and review decisions.

Names of persons need a language model that is not available offline; a title before a capitalized
word stands in for it (``PERSON_AFTER_TITLE``) and goes to review, never to automatic redaction.  Licence
numbers with a check digit are not recognized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gates
from .fixed import CASED, RECOGNIZERS

PERSON_AFTER_TITLE = r"\b(?:M\.|Mr\.?|Mme|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s+[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+)?"
#: What each match of a recognizer holds, where no string is certain.
DIGITS = {"IP_ADDRESS": r"[0-9]\.[0-9]", "FR_NIR": r"(?U)[12]\s?\d{2}\s?\d{2}\s?\d", "PHONE_NUMBER": r"[0-9]{2}[ .-][0-9]{2}"}
BIRTH_FORMATS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d"]


def _pattern(category: str, patterns: list[str]) -> str:
    joined = patterns[0] if len(patterns) == 1 else "|".join(f"(?:{p})" for p in patterns)
    return ("(?U)" if category in CASED else "(?iU)") + joined


def _may(text: Column, low: Column, category: str, patterns: list[str]) -> Column:
    """Whether a text (``low``: in lower case) has the string or the digits that a recognizer needs."""
    digits = DIGITS.get(category)
    return text.rlike(digits) if digits else gates.may_match(low, patterns)


def matches(text: Column) -> Column:
    """array<struct<category, value_hash>> of all recognizers, in their order; each runs only on texts with what it needs."""
    return gates.once(text, lambda t: gates.once(gates.lowered(t), lambda low: _matches(t, low)))


def _matches(text: Column, low: Column) -> Column:
    def found_as(category: str):
        return lambda v: F.struct(F.lit(category).alias("category"), F.sha2(v, 256).alias("value_hash"))

    none = F.array().cast("array<string>")
    values = lambda c, p: F.when(_may(text, low, c, p), F.regexp_extract_all(text, F.lit(_pattern(c, p)), F.lit(0))).when(text.isNotNull(), none)
    return F.flatten(F.array(*[F.transform(values(c, p), found_as(c)) for c, _, p in RECOGNIZERS]))


def categories(text: Column) -> Column:
    """The sorted categories found in a text; PERSON where a title stands before a name."""
    def found(t: Column, low: Column) -> Column:
        tests = {c: _may(t, low, c, p) & t.rlike(_pattern(c, p)) for c, _, p in RECOGNIZERS} | {"PERSON": t.rlike(PERSON_AFTER_TITLE)}
        return F.array_compact(F.array(*[F.when(tests[c], c) for c in sorted(tests)]))

    return gates.once(text, lambda t: gates.once(gates.lowered(t), lambda low: found(t, low)))


def redact(text: Column) -> Column:
    """Every match replaced by its category's token, one recognizer after the other."""
    return gates.once(text, lambda t: gates.once(gates.lowered(t), lambda low: _redacted(t, low)))


def _redacted(text: Column, low: Column) -> Column:
    def kept(category: str, token: str, patterns: list[str]):
        return lambda t: F.when(_may(t, low, category, patterns), F.regexp_replace(t, _pattern(category, patterns), token)).otherwise(t)

    tokens: list[str] = []
    for c, token, p in RECOGNIZERS:
        # what is needed must stand in the text from the start, unless a token brings it
        brought = any(w in t.lower() for q in p for w in gates.needed(q) or () for t in tokens)
        text = F.regexp_replace(text, _pattern(c, p), token) if brought else gates.once(text, kept(c, token, p))
        tokens.append(token)
    return text


def residual(redacted: Column) -> Column:
    """Categories that a scan still finds in a redacted text, names for review aside; none are expected."""
    return F.array_except(categories(redacted), F.array(F.lit("PERSON")))


def masked(value: Column) -> Column:
    """First and last character with stars between; all stars up to two."""
    n = F.length(value)
    return F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(value, 1, 1), F.repeat(F.lit("*"), n - 2), F.substring(value, -1, 1)))


def age_at(birth: Column, reference: Column, low: int = 0, high: int = 120) -> Column:
    """Whole years from a birth date in one of six formats; null out of range."""
    day = F.coalesce(*[F.to_date(F.try_to_timestamp(birth, F.lit(f))) for f in BIRTH_FORMATS])
    years = F.floor(F.months_between(reference, day) / 12).cast("int")
    return F.when(years.between(low, high), years)


def redact_once_per_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_matches, redacted digest): each distinct text is scanned once, then joined back."""
    keyed = docs.select(key, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    once = keyed.groupBy("text_hash").agg(F.any_value("text").alias("text"))
    once = once.select("text_hash", F.size(matches(F.coalesce("text", F.lit("")))).alias("n_matches"), F.sha2(redact(F.coalesce("text", F.lit(""))), 256).alias("redacted_hash"))
    return keyed.select(key, "text_hash").join(once, "text_hash").select(key, "n_matches", "redacted_hash")


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """records (id, text, content_hash) with human decisions (id, decision, content_hash, target, replacement).

    A decision counts only if it was taken on the text as it is (``content_hash``); else it is STALE.
    """
    d = decisions.select("id", "decision", F.col("content_hash").alias("decided_hash"), "target", "replacement")
    j = records.join(d, "id", "left")
    state = (
        F.when(F.col("decision").isNull(), "PENDING")
        .when(F.col("decided_hash") != F.col("content_hash"), "STALE")
        .when(F.col("decision") == "approve", "APPROVED")
        .when(F.col("decision") == "redact", "REDACTED")
        .when(F.col("decision") == "exclude", "EXCLUDED")
        .otherwise("INVALID")
    )
    text = F.when(state == "REDACTED", F.replace(F.col("text"), F.col("target"), F.col("replacement"))).otherwise(F.col("text"))
    return j.select("id", text.alias("text"), state.alias("privacy_status"))
