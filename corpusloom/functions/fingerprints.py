"""Stable keys and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, key_text, normalized

SEPARATOR = "␟"


def text_digest(text: Column) -> Column:
    return F.sha2(key_text(text), 256)


def context_hash(text: Column) -> Column:
    return F.sha2(normalized(text), 256)


def record_id(*parts: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of the folded, joined parts."""
    folded = [F.trim(F.regexp_replace(fold_accents(F.trim(p.cast("string"))), r"\s+", " ")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, *folded), 256), 1, 24)


def pair_id(prefix: str, key: Column) -> Column:
    return F.substring(F.sha1(F.concat(F.lit(prefix + ":"), key.cast("string"))), 1, 24)


def seeded_order(key: Column, seed: int = 42) -> Column:
    """The digest of the JSON list [seed, key], a reproducible random order."""
    return F.sha2(F.concat(F.lit(f'[{seed},"'), key.cast("string"), F.lit('"]')), 256)


def unordered_pair(a: Column, b: Column) -> Column:
    return F.sha2(F.concat_ws(SEPARATOR, F.array_sort(F.array(a, b))), 256)


def content_digest(fields: dict[str, Column]) -> Column:
    """The digest of a JSON object with sorted keys."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def grouping_keys(family: Column, context: Column, question: Column, choices: Column, labels: Column, answer: Column, chosen: Column, rejected: Column, assembled: Column) -> Column:
    """struct(input_key, context_key, question_key, target_key, example_key): digests that tell what two records share.

    Choices and labels count in sorted order; the context key is null without a context.
    """
    digest = lambda c: F.sha2(c, 256)
    options = F.coalesce(F.array_sort(F.transform(F.map_values(choices), key_text)), F.array().cast("array<string>"))
    asked = F.to_json(F.struct(key_text(context).alias("context"), key_text(question).alias("question"), options.alias("choices")))
    target = (
        F.when(family == "dpo", F.to_json(F.array(key_text(chosen), key_text(rejected))))
        .when(F.size(F.coalesce(F.map_keys(choices), F.array().cast("array<string>"))) > 0, F.to_json(F.array_sort(labels)))
        .otherwise(key_text(answer))
    )
    whole = digest(key_text(assembled))
    return F.struct(
        whole.alias("input_key"),
        F.when(key_text(context) != "", digest(key_text(context))).alias("context_key"),
        digest(asked).alias("question_key"),
        digest(target).alias("target_key"),
        digest(F.to_json(F.array(family, whole, target))).alias("example_key"),
    )


def json_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the compact JSON of the fields, keys sorted, nulls written."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)
