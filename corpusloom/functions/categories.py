"""Medical, triage, risk and sensitivity categories of texts by dictionaries of patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .curation import triage_marker_status
from .fixed_categories import MEDICAL_TERMS, RISK, SENSITIVE_HEALTH, TRIAGE
from .gates import may_match
from .text import fold_accents, key_text

WIDE = "(?U)"


def folded(text: Column) -> Column:
    """Lower case without accents, blanks collapsed, punctuation kept."""
    return fold_accents(key_text(text))


def _any_of(patterns: list[str]) -> str:
    """One pattern for several that all begin at the border of a word, which is then sought once."""
    border = r"\b"
    assert all(p.startswith(border) for p in patterns)
    return WIDE + border + "(?:" + "|".join(p.removeprefix(border) for p in patterns) + ")"


def detect(text: Column, markers: dict[str, list[str]]) -> Column:
    """Names whose patterns stand in a folded text, in the order of the dictionary."""
    return F.array_compact(F.array(*[F.when(may_match(text, p) & text.rlike(_any_of(p)), k) for k, p in markers.items()]))


def medical_markers(text: Column) -> Column:
    """How many different medical terms are words of a folded text; an apostrophe or hyphen joins words."""
    words = F.regexp_extract_all(text, F.lit(WIDE + r"\b[\w'-]+\b"), F.lit(0))
    return F.size(F.array_intersect(words, F.array(*map(F.lit, MEDICAL_TERMS))))


def medical_status(markers: Column) -> Column:
    return F.when(markers == 0, "NO_MARKER_DETECTED").when(markers <= 2, "MEDICAL_MARKERS_PRESENT").otherwise("MEDICAL_MARKERS_STRONG")


def with_medical_details(records: DataFrame, text: str) -> DataFrame:
    """Add counts, statuses and categories of one text column; a null text has none."""
    r = records.withColumn("_folded", folded(F.col(text)))
    named = {"triage": TRIAGE, "risk": RISK, "sensitive_health": SENSITIVE_HEALTH}
    r = r.withColumns({f"{k}_categories": detect(F.col("_folded"), m) for k, m in named.items()} | {"medical_marker_count": medical_markers(F.col("_folded"))})
    n = F.size("triage_categories")
    return r.withColumns({
        "medical_status": medical_status(F.col("medical_marker_count")),
        "triage_marker_count": n,
        "triage_status": triage_marker_status(n),
        "risk_flag": F.size("risk_categories") > 0,
    }).drop("_folded")
