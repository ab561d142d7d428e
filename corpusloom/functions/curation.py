"""Statuses, scores and orders of curated records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CASE_REFERENCE, CONFIDENCE_ROUTING, REWRITE_FORBIDDEN, VERDICT_RANK
from .text import key_text


def mapped(value: Column, table: dict, default) -> Column:
    """The value of a fixed table for a key, ``default`` for others."""
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(value == k, F.lit(v)).otherwise(out)
    return out


def verdict_rank(verdict: Column) -> Column:
    return mapped(verdict, VERDICT_RANK, len(VERDICT_RANK))


def routing_confidence(level: Column) -> Column:
    return mapped(F.lower(F.trim(level)), CONFIDENCE_ROUTING, 0.0)


def quality_order(quality: Column, confidence: Column, verdict: Column, notes: Column, draw: Column) -> list[Column]:
    """Best first: quality, confidence, verdict, fewest notes, then a reproducible draw."""
    zero = F.lit(0.0)
    return [F.coalesce(quality, zero).desc(), F.coalesce(confidence, zero).desc(), verdict_rank(verdict).asc(), F.coalesce(F.size(notes), F.lit(0)).asc(), draw.asc()]


def autonomy(question: Column, context: Column) -> Column:
    """Does a question lean on a case, and is its context there."""
    leans = F.coalesce(question, F.lit("")).rlike("(?U)" + CASE_REFERENCE)
    held = key_text(context) != ""
    return F.when(leans & held, "DEPENDENT_WITH_CONTEXT").when(leans, "DEPENDENT_WITHOUT_CONTEXT").otherwise("AUTONOMOUS_OR_UNDETECTED")


def triage_marker_status(markers: Column) -> Column:
    return F.when(markers >= 3, "TRIAGE_MARKERS_STRONG").when(markers >= 1, "TRIAGE_MARKERS_PRESENT").otherwise("NO_TRIAGE_MARKER_DETECTED")


def rewrite_problems(explanation: Column) -> Column:
    """FORBIDDEN_WORD and TOO_LONG (over 75 words) of a rewritten explanation."""
    t = F.coalesce(explanation, F.lit(""))
    words = F.when(key_text(t) == "", 0).otherwise(F.size(F.split(key_text(t), " ")))
    return F.array_compact(F.array(F.when(t.rlike("(?U)" + REWRITE_FORBIDDEN), "FORBIDDEN_WORD"), F.when(words > 75, "TOO_LONG")))


def pair_quality(patient_like: Column, context_words: Column, chosen_words: Column, rejected_words: Column, qcm_like: Column, markdown: Column, critical: Column, base: Column) -> Column:
    """``base`` with half a point for a patient, one for each length in range, less for artefacts and critical issues."""
    one = lambda c: c.cast("double")
    gains = one(patient_like) * 0.5 + one(context_words.between(40, 350)) + one(chosen_words.between(25, 130)) + one(rejected_words.between(25, 130))
    return base + gains - one(qcm_like) * 1.5 - one(markdown) * 1.5 - one(critical) * 10.0


def reference_status(priority: Column, method: Column, candidates: Column, strong: list[str], ambiguous: list[str]) -> Column:
    """strong: a priority by a strong method; ambiguous: an ambiguous method or any candidates; else none."""
    some = F.coalesce(F.size(candidates) > 0, F.lit(False))
    return F.when(priority.isin(1, 2, 3) & method.isin(strong), "strong").when(F.coalesce(method.isin(ambiguous), F.lit(False)) | some, "ambiguous").otherwise("none")


def final_priority(status: Column, priority: Column, candidates: Column) -> Column:
    """struct(priority, validation) from a strong reference or the only candidate; null else."""
    only = F.array_distinct(candidates)
    alone = (F.size(only) == 1) & F.get(only, F.lit(0)).isin(1, 2, 3)
    strong = (status == "strong") & priority.isin(1, 2, 3)
    named = lambda p, v: F.struct(p.cast("int").alias("priority"), F.lit(v).alias("validation"))
    return F.when(strong, named(priority, "strong_reference")).when(alone, named(F.get(only, F.lit(0)), "unique_candidate_priority"))


def information_score(patient_fields: Column, knowledge_fields: Column, patient_motifs: Column, knowledge_motifs: Column) -> Column:
    return 2 * patient_fields + knowledge_fields + 3 * patient_motifs + 2 * knowledge_motifs


def best_matches(matches: Column, top: int = 5) -> Column:
    """array<struct<score, rule_id>> of positive scores, best first, ties by rule."""
    good = F.filter(matches, lambda m: m["score"] > 0)
    ranked = F.array_sort(F.transform(good, lambda m: F.struct((-m["score"]).alias("least"), m["rule_id"].alias("rule_id"))))
    return F.slice(F.transform(ranked, lambda m: F.struct((-m["least"]).alias("score"), m["rule_id"].alias("rule_id"))), 1, top)


def match_status(matches: Column, least: float, margin: float) -> Column:
    """no_match, weak_match (best below ``least``), ambiguous_match (next closer than ``margin``) or matched."""
    best = best_matches(matches)
    first, second = F.get(best, F.lit(0))["score"], F.coalesce(F.get(best, F.lit(1))["score"], F.lit(0.0))
    return F.when(F.size(best) == 0, "no_match").when(first < least, "weak_match").when(first - second < margin, "ambiguous_match").otherwise("matched")


def evidence_path(has_patient: Column, has_knowledge: Column) -> Column:
    """Which rules a record is held against."""
    return F.when(has_patient, "patient").when(has_knowledge, "knowledge").otherwise("none")


def review_state(decision: Column) -> Column:
    """APPROVED, REJECTED or PENDING by a reviewer's decision."""
    d = F.lower(F.trim(decision))
    return F.when(d.isin("approve", "pass"), "APPROVED").when(d.isin("reject", "fail"), "REJECTED").otherwise("PENDING")
