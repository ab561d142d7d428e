"""What questions ask for, which answers of a multiple choice are right, and case texts without their options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_knowledge import ANATOMY, CHOICE_OPTION, CHOICE_QUESTION, INTENTS, NOT_CONFLICT, NOT_DUPLICATE, SUBJECTS
from .gates import lowered, may_match, once
from .records import unique_texts
from .text import clean_text

ANY_CASE = "(?iU)"


def question_intent(question: Column) -> Column:
    """The first intent whose pattern is in the question; null if none is."""
    q = clean_text(question)
    return F.coalesce(*[F.when(q.rlike(ANY_CASE + p), F.lit(name)) for name, p in INTENTS])


def question_subject(question: Column) -> Column:
    """What the question is about, by the first pattern that fits; null if none does."""
    q = clean_text(question)
    return F.coalesce(*[F.nullif(clean_text(F.regexp_extract(q, ANY_CASE + p, 1)), F.lit("")) for p in SUBJECTS])


def _gated(text: Column, hit, terms: list[str]) -> Column:
    return once(lowered(text), lambda low: F.array_compact(F.array(*[hit(low, t) for t in terms])))


def anatomy(text: Column, language: Column) -> Column:
    """Sorted anatomical terms that stand as whole words; none in languages other than French and English."""
    code = F.substring(F.lower(F.trim(language)), 1, 2)
    found = F.array().cast("array<string>")
    for lang, terms in ANATOMY.items():
        hit = lambda low, t: F.when(may_match(low, [t]) & text.rlike(rf"{ANY_CASE}(?<!\w){t}(?!\w)"), F.lit(t))
        hits = _gated(text, hit, sorted(terms))
        found = F.when(code == lang, hits).otherwise(found)
    return found


def correct_labels(value: Column) -> Column:
    """Labels A to E of a list in a string, in order, each once; anything else in it is passed over."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"[,;/|\s]+"), lambda v: F.upper(F.trim(v)))
    return F.array_distinct(F.filter(parts, lambda v: v.rlike("^[A-E]$")))


def _named(choices: Column) -> Column:
    """array<struct<label, text>> of the choices with a text."""
    entries = F.transform(F.coalesce(F.map_entries(choices), F.array()), lambda e: F.struct(F.upper(clean_text(e["key"])).alias("label"), clean_text(e["value"]).alias("text")))
    return F.filter(entries, lambda e: e["text"] != "")


def correct_answers(choices: Column, labels: Column, answer: Column) -> Column:
    """Texts of the right labels, then the direct answer (a label stands for its text), without repeats."""
    named, direct = _named(choices), clean_text(answer)
    text_of = lambda label: F.get(F.filter(named, lambda e: e["label"] == label), F.lit(0))["text"]
    last = F.when(direct != "", F.coalesce(text_of(F.upper(direct)), direct))
    return unique_texts(F.array_compact(F.concat(F.transform(labels, text_of), F.array(last))))


def distractors(choices: Column, labels: Column) -> Column:
    """array<struct<label, text>> of the choices that are not right; never knowledge."""
    return F.filter(_named(choices), lambda e: ~F.array_contains(labels, e["label"]))


def clinical_narrative(text: Column) -> Column:
    """The text before its first answer option, without the question lines and empty lines at its end."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^\s*(?:input|context)\s*:\s*", "")
    head = F.get(F.split(t, CHOICE_OPTION, 2), F.lit(0))
    lines = F.transform(F.split(head, r"\r\n|[\n\r]"), lambda x: x)
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    told = lambda x: (bare(x) != "") & ~bare(x).endswith("?") & ~bare(x).rlike("^" + CHOICE_QUESTION)
    last = F.array_max(F.transform(lines, lambda x, i: F.when(told(x), i + 1).otherwise(0)))
    return bare(F.when(t.rlike(CHOICE_OPTION), F.array_join(F.slice(lines, F.lit(1), last), "\n")).otherwise(t))


def case_explanation(answer: Column) -> Column:
    """What follows EXPLANATION: in an answer, or the whole answer."""
    t = F.coalesce(answer, F.lit(""))
    tail = F.when(t.rlike(r"EXPLANATION:"), F.regexp_extract(t, r"(?s)EXPLANATION:\s*(.*)", 1)).otherwise(t)
    return F.regexp_replace(tail, r"^\s+|\s+$", "")


def branch_text(prompt: Column, question: Column) -> Column:
    """The prompt, or the question where there is none."""
    return F.trim(F.coalesce(F.nullif(prompt, F.lit("")), question, F.lit("")))


def may_repeat(excluded: Column, flags: Column) -> Column:
    """Whether a record takes part in duplicate groups."""
    return ~_barred(excluded, flags, NOT_DUPLICATE)


def may_conflict(excluded: Column, flags: Column) -> Column:
    """Whether a record takes part in conflict groups."""
    return ~_barred(excluded, flags, NOT_CONFLICT)


def _barred(excluded: Column, flags: Column, names: list[str]) -> Column:
    return F.coalesce(excluded, F.lit(False)) | F.coalesce(F.arrays_overlap(flags, F.array(*map(F.lit, names))), F.lit(False))


def extraction_case(patient_fields: Column, knowledge_fields: Column, patient_motifs: Column, has_evidence: Column) -> Column:
    """What an extraction lacks, from the counts of its fields and motifs."""
    return (
        F.when((patient_fields == 0) & (knowledge_fields == 0), "NOT_EXTRACTED")
        .when(patient_fields == 0, "KNOWLEDGE_ONLY")
        .when(has_evidence, "OK")
        .when(patient_motifs > 0, "PATIENT_MOTIF_WITHOUT_EVIDENCE")
        .otherwise("PATIENT_NOT_RECOGNIZED")
    )
