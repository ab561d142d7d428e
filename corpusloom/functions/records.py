"""Canonical records: choices, labels, completions and assembled texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, key_text

LETTERS = "ABCDE"


def choices_map(values: list[Column] | Column) -> Column:
    """Answers (five columns, or one array) to a map from A-E; empty answers are left out."""
    a = F.array(*values) if isinstance(values, list) else F.slice(values, 1, 5)
    full = F.filter(F.arrays_zip(F.array(*[F.lit(x) for x in LETTERS]).alias("k"), F.transform(a, lambda v: F.trim(F.coalesce(v, F.lit("")))).alias("v")), lambda e: F.coalesce(e["v"], F.lit("")) != "")
    return F.map_from_entries(full)


def parse_labels(value: Column) -> Column:
    """Sorted labels of 'A', 'A,B' or 'ABD'; null where anything else stands in it or a label repeats."""
    bare = F.upper(F.regexp_replace(F.trim(value), r"[\s,;/]+", ""))
    found = F.array_sort(F.regexp_extract_all(bare, F.lit("[A-E]"), F.lit(0)))
    return F.when(bare.rlike("^[A-E]+$") & (F.size(F.array_distinct(found)) == F.size(found)), found)


def lenient_labels(value: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(value, F.lit(""))), F.lit("[A-E]"), F.lit(0)))


def assemble_input(context: Column, question: Column, choices: Column | None = None) -> Column:
    """Context and question, a blank line between, then a line for each choice in order; empty parts are left out."""
    full = lambda c: F.nullif(clean_text(c), F.lit(""))
    parts = [F.nullif(F.concat_ws("\n\n", full(context), full(question)), F.lit(""))]
    if choices is not None:
        lines = F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e["key"], F.lit(". "), e["value"]))
        parts.append(F.nullif(F.array_join(lines, "\n"), F.lit("")))
    return F.concat_ws("\n", *parts)


def labelled_lines(fields: dict[str, Column]) -> Column:
    """``name: value`` lines of the fields that are not empty."""
    lines = [F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", F.concat(F.lit(k + ": "), F.trim(c.cast("string")))) for k, c in fields.items()]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def drop_placeholder(narrative: Column) -> Column:
    t = F.trim(F.coalesce(narrative, F.lit("")))
    return F.when(F.lower(t).isin("n/a", "none", "null", "nan", "unknown", "-"), "").otherwise(t)


def source_id(value: Column, dataset: Column, index: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(value.cast("string")), F.lit("")), F.concat_ws(":", dataset, index.cast("string")))


def priority_number(value: Column) -> Column:
    """1, '1' or 'P1' to 1; null otherwise."""
    n = F.regexp_extract(F.upper(F.trim(value.cast("string"))), r"^P?([1-3])$", 1)
    return F.nullif(n, F.lit("")).cast("int")


def parse_completion(text: Column) -> tuple[Column, Column]:
    """(priority, explanation) of a model's answer; thinking blocks and what follows a stop mark are dropped."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    priority = F.nullif(F.regexp_extract(t, r"PRIORITY:\s*P([1-3])", 1), F.lit("")).cast("int")
    tail = F.regexp_extract(t, r"(?s)EXPLANATION:\s*(.*)", 1)
    return priority, F.trim(F.regexp_replace(tail, r"(?s)(?:<\||</s>|\n\n).*", ""))


def chat_messages(system: Column, user: Column, assistant: Column | None = None) -> Column:
    turns = [("system", system), ("user", user)] + ([("assistant", assistant)] if assistant is not None else [])
    made = F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns])
    return F.filter(made, lambda m: F.coalesce(m["content"], F.lit("")) != "")


def last_assistant(messages: Column) -> Column:
    """The content of the last assistant message of an array<struct<role, content>>."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(-1))["content"]


def richness(fields: list[Column]) -> tuple[Column, Column]:
    """(score, level): how many fields are not empty."""
    n = sum((F.when(F.trim(F.coalesce(c.cast("string"), F.lit(""))) != "", 1).otherwise(0) for c in fields), F.lit(0))
    return n, F.when(n >= 6, "strong").when(n >= 4, "medium").when(n >= 2, "weak").otherwise("none")


def completion(messages: Column, prompt: Column) -> Column:
    """The assistant's text of messages array<struct<role, content>>: one assistant message, or the prompt and then it; else null."""
    one, two = F.get(messages, F.lit(0)), F.get(messages, F.lit(1))
    after = (F.size(messages) == 2) & (one["role"] == "user") & (key_text(one["content"]) == key_text(prompt)) & (two["role"] == "assistant")
    return F.when((F.size(messages) == 1) & (one["role"] == "assistant"), clean_text(one["content"])).when(after, clean_text(two["content"]))


def context_sections(narratives: list[Column], sections: dict[str, Column]) -> Column:
    """The first narrative that is not empty under its title, then titled lines (array columns) where there are any."""
    first = F.coalesce(*[F.nullif(clean_text(n), F.lit("")) for n in narratives])
    titles = list(sections)
    parts = [F.when(first.isNotNull(), F.concat(F.lit(titles[0] + ":\n"), first))] if titles and sections[titles[0]] is None else []
    parts += [F.when(F.size(c) > 0, F.concat(F.lit(t + ":\n"), F.array_join(c, "\n"))) for t, c in sections.items() if c is not None]
    return F.concat_ws("\n\n", *parts)


def field_texts(fields: dict[str, Column], choices: Column | None = None) -> Column:
    """array<struct<field, text>> of all fields and choices with a text."""
    items = [F.struct(F.lit(k).alias("field"), c.cast("string").alias("text")) for k, c in fields.items()]
    out = F.array(*items)
    if choices is not None:
        out = F.concat(out, F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.struct(F.concat(F.lit("choices."), e["key"]).alias("field"), e["value"].alias("text"))))
    return F.filter(out, lambda x: F.coalesce(key_text(x["text"]), F.lit("")) != "")


def all_text(fields: dict[str, Column], choices: Column | None = None) -> Column:
    return F.array_join(F.transform(field_texts(fields, choices), lambda x: x["text"]), "\n")


def merge_missing(base: Column, patch: Column) -> Column:
    """A scalar: the patch only where the base is empty."""
    return F.coalesce(F.nullif(F.trim(base.cast("string")), F.lit("")), patch.cast("string"))


def unique_texts(values: Column) -> Column:
    """Texts of an array, the first of those that differ by letter case only, empty ones left out."""
    full = F.filter(F.transform(values, key_text), lambda v: v != "")
    seen = lambda acc, v: F.exists(acc, lambda x: F.lower(x) == F.lower(v))
    return F.aggregate(full, F.array().cast("array<string>"), lambda acc, v: F.when(seen(acc, v), acc).otherwise(F.concat(acc, F.array(v))))
