"""Semantic quality of canonical records: six dimensions, their verdict, score and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import flags as flagging
from corpusloom.functions.fixed import LABEL_REVEALED, SEMANTIC_BLOCKING, SEMANTIC_DOUBTFUL, SEMANTIC_REASONS
from corpusloom.functions.text import clean_text, key_text

PASS, REVIEW, FAIL = "PASS", "REVIEW", "FAIL"
#: A text repeated in its source counts as a leak from this length on.
LEAK_LENGTH = 30
STRINGS = "array<string>"


def _reason(name: str, *found: Column) -> Column:
    parts = SEMANTIC_REASONS[name].split("{}")
    return F.concat(F.lit(parts[0]), *[x for f, p in zip(found, parts[1:]) for x in (f, F.lit(p))])


def _case(*cases: tuple[Column, str, Column | None]) -> Column:
    """struct(verdict, reason) of the first case that holds; PASS without a reason if none does."""
    made = lambda v, r: F.struct(F.lit(v).alias("verdict"), (F.lit(None).cast("string") if r is None else r).alias("reason"))
    return F.coalesce(*[F.when(when, made(v, r)) for when, v, r in cases], made(PASS, None))


def _listed(have: Column, names: list[str]) -> Column:
    return F.array_sort(F.array_intersect(have, F.array(*map(F.lit, names))))


def _some(values: Column) -> Column:
    return F.size(values) > 0


def _either(a: str, b: str) -> Column:
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))


def _choice_alignment() -> Column:
    labels, choices = F.col("labels"), F.col("choices")
    unknown = F.array_except(labels, F.map_keys(choices))
    hollow = F.filter(labels, lambda x: clean_text(choices[x]) == "")
    return _case(
        (~_some(labels), FAIL, _reason("no_labels")),
        (_some(unknown), FAIL, _reason("unknown_labels", F.array_join(unknown, ", "))),
        (_some(hollow), FAIL, _reason("hollow_labels", F.array_join(hollow, ", "))),
    )


def _open_alignment() -> Column:
    blocking, doubtful = _listed(F.col("flags"), SEMANTIC_BLOCKING), _listed(F.col("flags"), SEMANTIC_DOUBTFUL)
    is_open = F.col("family") == "open"
    return _case(
        (clean_text(F.col("answer")) == "", FAIL, _reason("no_answer")),
        (is_open & _some(blocking), FAIL, _reason("blocked_answer", F.array_join(blocking, ", "))),
        (is_open & _some(doubtful), REVIEW, _reason("doubtful_answer", F.array_join(doubtful, ", "))),
    )


def _language() -> Column:
    meant, found = (F.lower(clean_text(F.col(c))) for c in ("language", "detected_language"))
    return _case(((found != "") & (found != meant), REVIEW, _reason("language", found, meant)))


def _autonomy() -> Column:
    found = _listed(F.col("flags"), ["NEEDS_CONTEXT", "EXTERNAL_REFERENCE"])
    return _case((_some(found), REVIEW, _reason("autonomy", F.array_join(found, ", "))))


def _repeated(target: Column, source: Column) -> Column:
    return (F.length(target) >= LEAK_LENGTH) & F.contains(source, target)


def _leakage(is_pair: Column, is_choice: Column) -> Column:
    """Letter case counts, in the patterns of revealed labels too."""
    asked = key_text(F.concat_ws(" ", F.col("context"), F.col("question")))
    prompt = key_text(_either("input", "question"))
    told = F.array_compact(F.array(*[F.when(asked.rlike("(?U)" + LABEL_REVEALED.format(x.lower())), x) for x in "ABCDE"]))
    revealed = F.get(F.array_intersect(F.col("labels"), told), F.lit(0))
    pair = [(is_pair & _repeated(key_text(F.col(f"_{c}")), prompt), REVIEW, _reason("pair_leak", F.lit(c))) for c in ("chosen", "rejected")]
    return _case(
        *pair,
        (~is_pair & is_choice & revealed.isNotNull(), REVIEW, _reason("label_leak", revealed)),
        (~is_pair & ~is_choice & _repeated(key_text(F.col("answer")), asked), REVIEW, _reason("open_leak")),
    )


def assess(records: DataFrame) -> DataFrame:
    """Add the dimensions completeness, alignment (null for pairs), language, autonomy, text_quality, target_leakage and
    preference_consistency (null but for pairs), then confidence, verdict, quality_score, reason and status; ``flags`` are
    brought up to date. Needs family, question, context, input, answer, choices (map), labels, chosen, rejected, language,
    detected_language and flags; nulls count as empty. preference_chosen and preference_rejected, where there, come first."""
    kept = records.columns
    given = lambda c: _either(f"preference_{c}", c) if f"preference_{c}" in kept else F.col(c)
    empty = F.array().cast(STRINGS)
    r = records.withColumns({"labels": F.coalesce("labels", empty), "flags": F.coalesce("flags", empty), "_chosen": given("chosen"), "_rejected": given("rejected")})
    judged = F.array(*map(F.lit, SEMANTIC_BLOCKING + SEMANTIC_DOUBTFUL))
    fresh = F.when(F.col("family") == "open", F.array_union(F.array_except("flags", judged), flagging.semantic_open_flags(F.col("answer")))).otherwise(F.col("flags"))
    r = r.withColumn("flags", F.array_except(fresh, F.array(F.lit("SEMANTIC_REVIEW"))))

    is_pair, is_choice = F.coalesce(F.col("family") == "dpo", F.lit(False)), F.coalesce(F.size("choices"), F.lit(0)) > 0
    flagged = lambda *names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    lacking = {"no_prompt": clean_text(_either("input", "question")), "no_chosen": clean_text(F.col("_chosen")), "no_rejected": clean_text(F.col("_rejected"))}
    no_input, no_answer = clean_text(F.col("input")) == "", ~is_choice & (clean_text(F.col("answer")) == "")
    incomplete = F.when(is_pair, F.greatest(*[t == "" for t in lacking.values()])).otherwise(no_input | no_answer)
    same = (lacking["no_chosen"] != "") & (lacking["no_rejected"] != "") & (key_text(F.col("_chosen")) == key_text(F.col("_rejected")))
    against = flagged("DPO_INVERSION", "DPO_PREFERENCE_CYCLE")
    r = r.withColumns({
        "_alignment": F.when(~is_pair, F.when(is_choice, _choice_alignment()).otherwise(_open_alignment())),
        "_language": _language(),
        "_autonomy": _autonomy(),
        "_leakage": _leakage(is_pair, is_choice),
        "completeness": F.when(incomplete, FAIL).otherwise(PASS),
        "preference_consistency": F.when(is_pair, F.when(same | against, FAIL).otherwise(PASS)),
        "text_quality": F.when(flagged("TEXT_ANOMALY"), REVIEW).otherwise(PASS),
    })
    named = {"alignment": "_alignment", "language_quality": "_language", "autonomy": "_autonomy", "target_leakage": "_leakage"}
    said = lambda name, when: F.when(when, _reason(name))
    shared = [F.col(f"{c}.reason") for c in ("_language", "_autonomy", "_leakage")]
    of_pair = [*[said(n, t == "") for n, t in lacking.items()], said("same_pair", same), said("contradiction", against), *shared, said("length_bias", flagged("DPO_LENGTH_BIAS")), said("high_risk", flagged("HIGH_RISK"))]
    of_text = [said("no_input", no_input), F.col("_alignment.reason"), *shared, said("text", flagged("TEXT_ANOMALY"))]
    r = r.withColumns({k: F.col(f"{c}.verdict") for k, c in named.items()} | {
        "reason": F.nullif(F.when(is_pair, F.concat_ws(" ", *of_pair)).otherwise(F.concat_ws(" ", *of_text)), F.lit("")),
        "confidence": F.lit("DETERMINISTIC"),
    })
    last = F.coalesce("alignment", "preference_consistency")
    worst, mean = flagging.verdict([F.col(c) for c in ("completeness", "language_quality", "autonomy", "text_quality", "target_leakage")] + [last])
    r = r.withColumns({"verdict": worst, "quality_score": F.round(mean, 4)})
    doubtful = F.when(F.col("verdict") == REVIEW, F.array(F.lit("SEMANTIC_REVIEW"))).otherwise(empty)
    r = r.withColumns({"flags": F.array_sort(F.array_union("flags", doubtful)), "status": F.when(F.col("verdict") == FAIL, "SEMANTIC_QUALITY_FAILED").otherwise("ELIGIBLE")})
    return r.drop("_chosen", "_rejected", *named.values())
