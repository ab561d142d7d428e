"""What medical records tell of a patient and of medicine in general, and which of it was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import extraction, knowledge, signs
from corpusloom.functions.fixed_clinical import NUMBERS
from corpusloom.functions.fixed_concepts import CONCEPTS, NO_CONCEPTS
from corpusloom.functions.fixed_fields import FIELDS
from corpusloom.functions.fixed_signs import CRITICAL_SIGNS, NO_CRITICAL_SIGNS
from corpusloom.functions.text import clean_text

PRESSURES = ["systolic_bp", "diastolic_bp"]
VITALS = ["temperature", *PRESSURES, *[n for n in NUMBERS if n not in PRESSURES]]


def _joined(*texts: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*texts), clean_text), lambda t: t != ""), " ")


def _names(tests: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))


def _known(states: Column) -> Column:
    return F.exists(F.map_values(states), lambda s: s != "UNKNOWN")


def _some(values: Column) -> Column:
    return F.size(values) > 0


def extract_patient(records: DataFrame, context: str = "context", question: str = "question") -> DataFrame:
    """Add a struct ``patient`` of what context and question tell; nulls and empty arrays where they tell nothing.
    ``extracted_fields`` names what was found, sorted; a sign told and denied is a conflict."""
    text = F.col("_text")
    r = records.withColumn("_text", _joined(F.col(context), F.col(question)))
    r = r.withColumns({
        "_age": extraction.age(text),
        "_pressure": extraction.pressure(text),
        "_critical": signs.sign_states(CRITICAL_SIGNS, NO_CRITICAL_SIGNS)(text),
        "_concepts": signs.sign_states(CONCEPTS, NO_CONCEPTS)(text),
        "_symptoms": signs.symptoms(text),
        "_history": signs.medical_history(text),
        "_conditions": signs.conditions(text),
    })
    aged = lambda unit: F.when(F.col("_age.unit") == unit, F.col("_age.value"))
    facts = {unit: aged(unit) for unit in ("age_days", "age_months", "age_years")} | {
        "sex": extraction.sex(text), "duration": extraction.duration(text), "duration_minutes": extraction.duration_minutes(text), "evolution": extraction.evolution(text),
    }
    vitals = {"temperature": extraction.temperature(text), "systolic_bp": F.col("_pressure.s"), "diastolic_bp": F.col("_pressure.d")}
    vitals |= {n: extraction.vital(text, n) for n in NUMBERS if n not in vitals}
    r = r.withColumns({f"_{n}": v for n, v in (facts | vitals).items()})
    lists = {"symptoms": F.col("_symptoms"), "medical_history": F.col("_history"), "condition_mentions": F.col("_conditions"), "critical_signs": F.col("_critical.present")}
    states = {"critical_sign_states": F.col("_critical.states"), "french_concept_states": F.col("_concepts.states")}
    found = {n: F.col(f"_{n}").isNotNull() for n in facts} | {f"vital_signs.{n}": F.col(f"_{n}").isNotNull() for n in vitals}
    found |= {n: _some(v) for n, v in lists.items()} | {n: _known(v) for n, v in states.items()}
    patient = F.struct(
        *[F.col(f"_{n}").alias(n) for n in facts],
        F.struct(*[F.col(f"_{n}").cast("double").alias(n) for n in VITALS]).alias("vital_signs"),
        *[v.alias(n) for n, v in (lists | states).items()],
        F.array_sort(_names(found)).alias("extracted_fields"),
        F.col("_critical.conflicts").alias("critical_sign_conflicts"),
        F.col("_concepts.conflicts").alias("french_concept_conflicts"),
    )
    return r.select(*records.columns, patient.alias("patient"))


def extract_knowledge(records: DataFrame) -> DataFrame:
    """Add a struct ``medical_knowledge`` from context, question and right answers; wrong choices are kept apart and never
    read. Needs question, context, answer, choices (map), labels (a string of letters) and language."""
    r = records.withColumn("_labels", knowledge.correct_labels(F.col("labels")))
    r = r.withColumn("_answers", knowledge.correct_answers(F.col("choices"), F.col("_labels"), F.col("answer")))
    r = r.withColumns({"_text": _joined(F.col("context"), F.col("question"), F.array_join("_answers", " ")), "_intent": knowledge.question_intent(F.col("question"))})
    fields = {n: signs.knowledge_field(F.col("_text"), n) for n in FIELDS}
    told = F.when(F.col("_intent") == "symptoms", signs.frequency_items(F.array_join("_answers", " "))).otherwise(F.array().cast("array<string>"))
    fields["symptoms"] = signs.unique(F.concat(fields["symptoms"], told))
    fields["anatomy"] = knowledge.anatomy(F.col("_text"), F.col("language"))
    r = r.withColumns({f"_{n}": v for n, v in fields.items()})
    r = r.withColumn("_fields", _names({n: _some(F.col(f"_{n}")) for n in fields}))
    whole = lambda c: F.nullif(clean_text(F.col(c)), F.lit(""))
    out = F.struct(
        whole("question").alias("question"), knowledge.question_subject(F.col("question")).alias("question_subject"), whole("context").alias("context"), whole("answer").alias("source_answer"),
        F.col("_intent").alias("intent"), F.col("_labels").alias("correct_labels"), F.col("_answers").alias("correct_answers"), knowledge.distractors(F.col("choices"), F.col("_labels")).alias("distractors"),
        *[F.col(f"_{n}").alias(n) for n in fields],
        F.col("_fields").alias("extracted_fields"), _some(F.col("_answers")).alias("has_correct_answer"), _some(F.col("_fields")).alias("has_structured_medical_information"),
        (_some(F.col("_answers")) | _some(F.col("_fields"))).alias("has_source_medical_information"),
    )
    return r.select(*records.columns, out.alias("medical_knowledge"))


def recovered_candidates(candidates: Column, status: Column, recovered: Column) -> Column:
    """Rule ids of a record: its own, or where it has none those of a recovery that found exactly one match."""
    own, none = F.coalesce(candidates, F.array().cast("array<string>")), F.array().cast("array<string>")
    return F.when(_some(own), own).when(status == "unique_match", F.coalesce(recovered, none)).otherwise(none)


def extraction_summary(patient: Column, medical: Column, patient_rules: Column, knowledge_rules: Column) -> Column:
    """What an extraction found, as one struct for routing and reports."""
    p, k = patient["extracted_fields"], medical["extracted_fields"]
    return F.struct(
        _some(p).alias("has_patient_information"), _some(k).alias("has_medical_knowledge"), p.alias("patient_fields"), k.alias("medical_knowledge_fields"),
        patient_rules.alias("patient_french_motifs"), knowledge_rules.alias("knowledge_french_motifs"),
    )
