"""Clinical facts from text by patterns, as Column expressions.

A number counts only if all matches of its patterns give the same one, and then only within its limits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_clinical import AGE, CMHG_TO_MMHG, NUMBER_TENS, NUMBER_UNITS, NUMBERS, PATIENT_SEX, PLAUSIBLE, PRESSURE_CMHG, PRESSURE_MMHG, TEMPERATURE, WORD_AGE
from .fixed_signs import DURATIONS, EVOLUTIONS, MINUTES
from .gates import all_matches, matches_any, once
from .text import clean_text, key_text

ANY_CASE = "(?iU)"


def _number(value: Column) -> Column:
    return F.replace(F.regexp_replace(value, r"\s", ""), F.lit(","), F.lit(".")).try_cast("double")


def _found(text: Column, patterns: list[str], part: int = 1) -> Column:
    return all_matches(text, patterns, ANY_CASE, part)


def plausible(value: Column, name: str) -> Column:
    low, high = PLAUSIBLE[name]
    return once(value, lambda v: F.when(v.between(low, high), v))


def only_value(values: Column) -> Column:
    return once(F.array_distinct(values), lambda kinds: F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))))


def vital(text: Column, name: str) -> Column:
    """One of the numbers of ``NUMBERS``."""
    return plausible(only_value(F.transform(_found(text, NUMBERS[name]), _number)), name)


def temperature(text: Column) -> Column:
    """Celsius with one decimal; Fahrenheit values are converted."""
    pairs = F.arrays_zip(_found(text, TEMPERATURE).alias("v"), _found(text, TEMPERATURE, 2).alias("u"))
    warm = lambda p: F.when(F.lower(p["u"]).startswith("f"), (_number(p["v"]) - 32) * 5 / 9).otherwise(_number(p["v"]))
    return plausible(only_value(F.transform(pairs, lambda p: F.round(warm(p), 1))), "temperature")


def pressure(text: Column) -> Column:
    """struct(s, d), systolic and diastolic in mmHg: the first match that is plausible and in order, centimetres before
    millimetres; else each on its own."""
    ok = lambda p: p["s"].between(*PLAUSIBLE["systolic_bp"]) & p["d"].between(*PLAUSIBLE["diastolic_bp"]) & (p["s"] > p["d"])
    tried = []
    for patterns, factor in ((PRESSURE_CMHG, CMHG_TO_MMHG), (PRESSURE_MMHG, 1)):
        for pattern in patterns:
            s, d = (_number(F.regexp_extract(text, ANY_CASE + pattern, k)) * factor for k in (1, 2))
            tried.append(once(F.struct(s.alias("s"), d.alias("d")), lambda p: F.when(ok(p), p)))
    return F.coalesce(*tried, F.struct(vital(text, "systolic_bp").alias("s"), vital(text, "diastolic_bp").alias("d")))


def blood_pressure(text: Column) -> tuple[Column, Column]:
    both = pressure(text)
    return both["s"], both["d"]


def number_words() -> dict[str, int]:
    """Number words up to 99 and 100, hyphens as blanks and without "et": tens alone and with a unit."""
    tens = NUMBER_TENS | {"soixante dix": 70, "quatre vingt": 80, "quatre vingts": 80}
    table = {"cent": 100} | {k.replace("-", " "): v for k, v in NUMBER_UNITS.items()} | tens
    for name, ten in tens.items():
        table |= {f"{name} {u}": ten + v for u, v in NUMBER_UNITS.items() if "-" not in u and f"{name} {u}" not in tens}
    return table


def word_age(text: Column) -> Column:
    """Years of an age in French words."""
    table = F.create_map(*[F.lit(x) for kv in number_words().items() for x in kv])
    tried = []
    for p in WORD_AGE:
        words = F.replace(F.lower(F.regexp_extract(text, ANY_CASE + p, 1)), F.lit("-"), F.lit(" "))
        tried.append(plausible(table[F.trim(F.regexp_replace(F.regexp_replace(words, r"\s+", " "), r" et ", " "))], "age_years"))
    return F.coalesce(*tried)


def age(text: Column) -> Column:
    """struct(unit, value): days, months or years, the first that has one plausible value; else years in words."""
    named = lambda unit, value: once(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(unit).alias("unit"), v.cast("int").alias("value"))))
    tried = [named(unit, plausible(only_value(F.transform(_found(text, p), _number)), unit)) for unit, p in AGE.items()]
    return F.coalesce(*tried, named("age_years", word_age(text)))


def in_years(a: Column) -> Column:
    """Years of an ``age``; select that first, so that it is computed once."""
    return F.when(a["unit"] == "age_years", a["value"].cast("double")).when(a["unit"] == "age_months", a["value"] / 12).when(a["unit"] == "age_days", a["value"] / 365.25)


def age_years(text: Column) -> Column:
    return in_years(age(text))


def sex(text: Column) -> Column:
    """male or female if patterns of exactly one are there."""
    told = F.struct(*[matches_any(text, PATIENT_SEX[k], ANY_CASE).alias(k) for k in ("male", "female")])
    return once(told, lambda t: F.when(t["male"] & ~t["female"], "male").when(t["female"] & ~t["male"], "female"))


def duration(text: Column) -> Column:
    """How long something has lasted, as told, if all matches tell the same."""
    same = lambda told: F.size(F.array_distinct(F.transform(told, lambda v: F.lower(key_text(v))))) == 1
    return once(F.transform(_found(text, DURATIONS), clean_text), lambda told: F.when(same(told), F.get(told, F.lit(0))))


def duration_minutes(text: Column) -> Column:
    scale = lambda unit: F.coalesce(*[F.when(unit.rlike(f"^(?:{p})"), F.lit(float(n))) for p, n in MINUTES])
    return once(F.lower(duration(text)), lambda told: F.round(_number(F.regexp_extract(told, r"^[0-9.,]+", 0)) * once(F.regexp_extract(told, r"[a-z]+", 0), scale), 2))


def evolution(text: Column) -> Column:
    """worsening, improving, stable, sudden or progressive, if exactly one is told."""
    return only_value(F.array_compact(F.array(*[F.when(matches_any(text, p, ANY_CASE), k) for k, p in EVOLUTIONS.items()])))


def tri_state(text: Column, positive: str, negative: str) -> Column:
    """PRESENT, ABSENT or UNKNOWN (neither, or both): positives are sought where negatives are blanked out."""
    no = text.rlike(negative)
    yes = F.regexp_replace(text, negative, " ").rlike(positive)
    return F.when(yes & ~no, "PRESENT").when(no & ~yes, "ABSENT").otherwise("UNKNOWN")


def clinical_items(text: Column) -> Column:
    """Items of a list (comma, semicolon, et, and) with 3 to 240 characters and at most 30 words."""
    items = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?i)\s*(?:[,;]|\bet\b|\band\b)\s*"), lambda x: F.trim(x))
    return F.filter(items, lambda x: F.length(x).between(3, 240) & (F.size(F.split(x, r"\s+")) <= 30))


def shock_index(heart_rate: Column, systolic: Column) -> Column:
    return F.when((heart_rate > 0) & (systolic > 0), heart_rate / systolic)
