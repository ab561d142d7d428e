"""Signs, symptoms, conditions and history told in clinical texts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from .fixed_fields import FIELDS, FREQUENCY_ITEM, NOT_VALUES, QUESTION_TAIL
from .fixed_signs import CONDITIONS, HISTORY_NARRATIVES, HISTORY_SECTIONS, NO_HISTORY, NOT_CONDITIONS, NOT_SYMPTOMS, SYMPTOM_NARRATIVES, SYMPTOM_SECTIONS
from .gates import all_matches, needed, plain_case
from .text import clean_text, key_text

ANY_CASE = "(?iU)"
ITEM_BORDER = ANY_CASE + r"\s*(?:,|;|\bet\b|\band\b)\s*"
#: How far before a narrative its negation may stand.
REACH = 50
SIGNS = StructType([StructField("states", MapType(StringType(), StringType())), StructField("present", ArrayType(StringType())), StructField("conflicts", ArrayType(StringType()))])


def _fragments(values: Column) -> Column:
    """Cleaned values of 3 to 240 characters and at most 30 words."""
    cleaned = F.transform(values, clean_text)
    return F.filter(cleaned, lambda v: F.length(v).between(3, 240) & (F.size(F.split(key_text(v), " ")) <= 30))


def _matches(text: Column, patterns: list[str]) -> Column:
    return all_matches(text, patterns, ANY_CASE)


def unique(values: Column) -> Column:
    """The first of the texts that differ by letter case and blanks only."""
    key = lambda v: F.lower(key_text(v))
    return F.aggregate(values, F.array().cast("array<string>"), lambda kept, v: F.when(F.exists(kept, lambda x: key(x) == key(v)), kept).otherwise(F.concat(kept, F.array(v))))


def sections(text: Column, patterns: list[str]) -> Column:
    """Items of the lines that follow a heading."""
    return _fragments(F.flatten(F.transform(_matches(text, patterns), lambda v: F.split(clean_text(v), ITEM_BORDER))))


def narratives(text: Column, patterns: list[str], barred: list[str]) -> Column:
    """Fragments told in sentences, but for those that open with a barred pattern."""
    return F.filter(_fragments(_matches(text, patterns)), lambda v: ~v.rlike(ANY_CASE + "|".join(barred)))


def symptoms(text: Column) -> Column:
    """Each symptom once, letter case aside: sections first, then narratives."""
    return unique(F.concat(sections(text, SYMPTOM_SECTIONS), narratives(text, SYMPTOM_NARRATIVES, NOT_SYMPTOMS)))


def conditions(text: Column) -> Column:
    return unique(narratives(text, CONDITIONS, NOT_CONDITIONS))


def _values(values: Column) -> Column:
    return F.filter(_fragments(values), lambda v: ~v.rlike(ANY_CASE + "|".join(NOT_VALUES)))


def knowledge_field(text: Column, name: str) -> Column:
    """Values of one of ``FIELDS``, cut where they turn into a question."""
    return unique(_values(F.transform(_matches(text, FIELDS[name]), lambda v: F.regexp_replace(clean_text(v), ANY_CASE + QUESTION_TAIL, ""))))


def frequency_items(text: Column) -> Column:
    """What is told with a percentage or a ratio after it."""
    found = _values(F.regexp_extract_all(text, F.lit(FREQUENCY_ITEM), F.lit(1)))
    return unique(F.filter(found, lambda v: ~F.contains(key_text(v), F.lit("frequency of"))))


@pandas_udf(ArrayType(StringType()))
def _told_history(texts: pd.Series) -> pd.Series:
    told = [re.compile(p, re.IGNORECASE) for p in HISTORY_NARRATIVES]
    never = re.compile("|".join(NO_HISTORY), re.IGNORECASE)
    return pd.Series([[m[1] for p in told for m in p.finditer(t or "") if not never.search(t[max(0, m.start() - REACH) : m.end()])] for t in texts])


def medical_history(text: Column) -> Column:
    """Sections first, then narratives without a negation in them or shortly before."""
    return unique(F.concat(sections(text, HISTORY_SECTIONS), _fragments(_told_history(text))))


def _alternatives(pattern: str) -> list[str]:
    """A pattern cut at its bars outside of groups and classes."""
    parts, depth, listed, escaped = [""], 0, False, False
    for ch in pattern:
        if not escaped and not listed:
            depth += (ch == "(") - (ch == ")")
        if ch == "|" and not (depth or listed or escaped):
            parts.append("")
            continue
        listed = not escaped and (ch == "[" or listed and ch != "]") or escaped and listed
        escaped = ch == "\\" and not escaped
        parts[-1] += ch
    return parts


def any_sign(patterns: list[str]) -> re.Pattern:
    """Found wherever one of the patterns is; if all begin at the border of a word, that is sought once for all."""
    border, parts = r"\b", [a for p in patterns for a in _alternatives(p)]
    shared = all(a.startswith(border) for a in parts)
    return re.compile((border if shared else "") + "(?:" + "|".join(a.removeprefix(border) if shared else a for a in parts) + ")", re.IGNORECASE)


def sign_states(positive: dict[str, list[str]], negative: dict[str, list[str]]):
    """A function of a text column: struct(states, present, conflicts). A sign is PRESENT where matches lie outside
    all negations, ABSENT where only negations are, else UNKNOWN; both together are a conflict too. Null: all UNKNOWN."""
    made = lambda p: [(re.compile(x, re.IGNORECASE), needed(x) or ("",)) for x in p]
    signs = [(name, made(p), made(negative.get(name, []))) for name, p in positive.items()]
    nothing = {name: "UNKNOWN" for name in positive}
    spans = lambda patterns, t, low: [m.span() for p, words in patterns if any(w in low for w in words) for m in p.finditer(t)]

    def told(t: str) -> tuple[dict, list, list]:
        low, states, conflicts = plain_case(t), nothing.copy(), []
        for name, yes, no in signs:
            against = spans(no, t, low)
            there = any(not any(a <= i and j <= b for a, b in against) for i, j in spans(yes, t, low))
            states[name] = "UNKNOWN" if there == bool(against) else "PRESENT" if there else "ABSENT"
            if there and against:
                conflicts.append(name)
        return states, sorted(k for k, v in states.items() if v == "PRESENT"), sorted(conflicts)

    @pandas_udf(SIGNS)
    def found(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([told(t or "") for t in texts], columns=["states", "present", "conflicts"])

    return found
