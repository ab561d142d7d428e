"""Raw question-answer and preference tables to one canonical record, by family."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import records
from corpusloom.functions.fingerprints import record_id
from corpusloom.functions.text import clean_text

from .aggregate import union_all

REQUIRED = {"mcqu": ["question", "answer_a", "correct_answers"], "mcqm": ["question", "answer_a", "correct_answers"], "open": ["question", "answer"], "dpo": ["prompt", "chosen", "rejected"]}


def canonicalize(raw: DataFrame, dataset: str, family: str) -> DataFrame:
    """id, dataset, family, source_id, context, question, choices, labels, answer, chosen, rejected, schema_error.

    A family's missing columns make ``schema_error`` and empty fields, not a failure.
    """
    missing = [c for c in REQUIRED[family] if c not in raw.columns]
    at = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    index = F.monotonically_increasing_id() if "source_index" not in raw.columns else F.col("source_index")
    sid = records.source_id(at("id"), F.lit(dataset), index)
    choices = records.choices_map([at(f"answer_{x}") for x in "abcde"]) if family.startswith("mcq") else F.lit(None).cast("map<string,string>")
    labels = records.parse_labels(at("correct_answers")) if family.startswith("mcq") else F.lit(None).cast("array<string>")
    error = F.lit("missing " + ", ".join(missing)) if missing else F.lit(None).cast("string")
    question = at("prompt") if family == "dpo" else at("question")
    return raw.select(sid.alias("source_id"), *[clean_text(x).alias(k) for k, x in (("context", at("clinical_case")), ("question", question), ("answer", at("answer")), ("chosen", at("chosen")), ("rejected", at("rejected")))],
                      choices.alias("choices"), labels.alias("labels"), error.alias("schema_error")).select(record_id(F.lit(dataset), F.lit(family), F.col("source_id")).alias("id"), F.lit(dataset).alias("dataset"), F.lit(family).alias("family"), "*")


def canonical_union(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    return union_all([canonicalize(*t) for t in tables])
