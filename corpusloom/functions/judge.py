"""Answers of a judging model: the first valid JSON object in noisy text, checked, with the verdict recomputed."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .flags import verdict
from .text import clean_text

#: What a judging model answers, and with which confidence.
SCORE_FIELDS = ["completeness", "relevance", "alignment", "safety"]
FIELDS = sorted([*SCORE_FIELDS, "confidence", "reason"])
VERDICTS = ["PASS", "REVIEW", "FAIL"]
CONFIDENCES = ["HIGH", "MEDIUM", "LOW"]
FALLBACK_REASON = "Sortie invalide après deux tentatives : {}."

OBJECT = "struct<found:boolean,keys:array<string>,values:map<string,string>,reason:string>"
OBJECTS = pa.struct([("found", pa.bool_()), ("keys", pa.list_(pa.string())), ("values", pa.map_(pa.string(), pa.string())), ("reason", pa.string())])
#: Texts that Python holds with their objects at once.
AT_ONCE = 64

DIMENSIONS = ["completeness", "alignment", "autonomy", "text_quality"]


def parse_judgement(text: Column) -> Column:
    """struct(valid, verdict, score, reason): dimensions must be PASS, REVIEW or FAIL; anything else is a REVIEW."""
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{[^{}]*\}", 0)
    field = lambda k: F.upper(F.trim(F.get_json_object(body, f"$.{k}")))
    dims = [field(k) for k in DIMENSIONS]
    valid = dims[0].isin("PASS", "REVIEW", "FAIL")
    for d in dims[1:]:
        valid = valid & d.isin("PASS", "REVIEW", "FAIL")
    valid = F.coalesce(valid, F.lit(False))
    worst, score = verdict([F.coalesce(d, F.lit("REVIEW")) for d in dims])
    return F.struct(valid.alias("valid"), F.when(valid, worst).otherwise("REVIEW").alias("verdict"), F.when(valid, score).alias("score"), F.get_json_object(body, "$.reason").alias("reason"))


def _objects(texts: list) -> list[tuple]:
    decoder, rows = json.JSONDecoder(), []
    for t in texts:
        t, at, held = (t or "").strip(), -1, None
        while held is None and (at := t.find("{", at + 1)) >= 0:
            try:
                held = decoder.raw_decode(t, at)[0]
            except (json.JSONDecodeError, RecursionError):
                continue
        held = held if isinstance(held, dict) else None
        reason = held.get("reason") if held else None
        rows.append((held is not None, sorted(held or {}), [(k, str(v)) for k, v in (held or {}).items()], reason if isinstance(reason, str) else None))
    return rows


def _first_object(texts: pa.Array) -> pa.Array:
    """A few texts at a time: the batches that Spark sends stay in Arrow."""
    parts = [pa.array([dict(zip(OBJECTS.names, r, strict=True)) for r in _objects(texts.slice(k, AT_ONCE).to_pylist())], OBJECTS) for k in range(0, len(texts), AT_ONCE)]
    return pa.concat_arrays(parts) if parts else pa.array([], OBJECTS)


def first_object(text: Column) -> Column:
    """The first brace of a text from which a whole JSON object reads: struct(found, sorted keys, values as text, reason).

    Braces inside strings, escapes and nested objects belong to the object; braces that open nothing valid are passed over.  Numbers and
    truth values are written as a scripting language writes them (True, 1.5); the reason is null unless it is a string.
    """
    return arrow_udf(_first_object, OBJECT)(text)


def _read(answer: Column) -> Column:
    """struct(error, scores, confidence, reason) of a found object; the error is null for a valid judgement."""
    said = lambda k: F.upper(clean_text(answer["values"][k]))
    scores, reason = F.array(*[said(k) for k in SCORE_FIELDS]), clean_text(answer["reason"])
    error = (
        F.when(~answer["found"] | (F.array_join(answer["keys"], ",") != ",".join(FIELDS)), "ValueError")
        .when(F.exists(scores, lambda x: ~F.coalesce(x.isin(*VERDICTS), F.lit(False))), "ValueError")
        .when(~F.coalesce(said("confidence").isin(*CONFIDENCES), F.lit(False)) | (reason == ""), "ValueError")
    )
    return F.struct(error.alias("error"), scores.alias("scores"), said("confidence").alias("confidence"), reason.alias("reason"))


def judgement(first: Column, retry: Column) -> Column:
    """struct of the four scores, confidence, verdict, reason and ``technical``, from ``first_object`` of an answer and of a second one.

    An object must have just the six fields, known scores and confidence, and a reason.  The verdict is worked out from the
    scores: FAIL before REVIEW before PASS.  Two invalid answers are a technical REVIEW.
    """
    a, b = _read(first), _read(retry)
    pick = lambda x, y: F.when(a["error"].isNull(), x).when(b["error"].isNull(), y)
    scores = F.coalesce(pick(a["scores"], b["scores"]), F.array(*[F.lit("REVIEW")] * 4))
    told = F.concat_ws(" / ", a["error"], b["error"])
    worst = F.when(F.array_contains(scores, "FAIL"), "FAIL").when(F.array_contains(scores, "REVIEW"), "REVIEW").otherwise("PASS")
    return F.struct(
        *[F.get(scores, F.lit(i)).alias(k) for i, k in enumerate(SCORE_FIELDS)],
        F.coalesce(pick(a["confidence"], b["confidence"]), F.lit("LOW")).alias("confidence"),
        worst.alias("verdict"),
        F.coalesce(pick(a["reason"], b["reason"]), F.format_string(FALLBACK_REASON.replace("{}", "%s"), told)).alias("reason"),
        (a["error"].isNotNull() & b["error"].isNotNull()).alias("technical"),
    )
