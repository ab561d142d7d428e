"""Declarative rules compiled to Column expressions.

A rule is a tree of {"all": [...]}, {"any": [...]} and {"field", "operator", "value"} leaves.  Matching is
three-valued SQL logic: a missing field is null, ``all`` is AND, ``any`` is OR, and an
undecided tree is null.  Unknown operators or fields are found when compiling: they match nothing and
mark an undecided rule as invalid rather than missing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import fold_term, whole_word

NUMERIC = {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
#: Order of urgency levels and their priorities.
LEVELS = {"1": 1, "2": 1, "3A": 2, "3B": 2, "4": 3, "5": 3}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    level: str
    priority: int
    tree: dict


def flatten_protocol(protocol: dict) -> list[Rule]:
    """One rule for each motif and level that has an automation tree, by level and id."""
    order = list(LEVELS)
    rules = [
        Rule(m["rule_id"], level, LEVELS[level], spec["automation"])
        for m in protocol["motifs"]
        for level, spec in m["triage_levels"].items()
        if spec.get("automation")
    ]
    return sorted(rules, key=lambda r: (order.index(r.level), r.rule_id))


def unresolved_motifs(protocol: dict) -> list[str]:
    return sorted(m["rule_id"] for m in protocol["motifs"] if m.get("cvc") != m.get("tri_m"))


class Compiler:
    """Compiles trees over named fields (name to Column)."""

    def __init__(self, fields: dict[str, Column]):
        self.fields = fields

    def _leaf(self, node: dict) -> Column | None:
        field, op, value = self.fields.get(node.get("field")), node.get("operator"), node.get("value")
        if field is None:
            return None
        if op in NUMERIC:
            return getattr(field.try_cast("double"), NUMERIC[op])(float(value))
        if op == "==":
            return field.try_cast("double") == float(value) if isinstance(value, (int, float)) else fold_term(field.cast("string")) == fold_term(F.lit(value))
        if op == "contains_any":
            folded = fold_term(field.cast("string"))
            hit = reduce(lambda a, b: a | b, [whole_word(folded, fold_term(F.lit(v))) for v in value], F.lit(False))
            return F.when(field.isNotNull(), hit)
        return None

    def match(self, node: dict) -> Column:
        for key, empty, join in (("all", True, lambda a, b: a & b), ("any", False, lambda a, b: a | b)):
            if key in node:
                return reduce(join, [self.match(n) for n in node[key]], F.lit(empty))
        leaf = self._leaf(node)
        return F.lit(None).cast("boolean") if leaf is None else leaf

    def score(self, node: dict) -> Column:
        """``all``: mean of the children; ``any``: their maximum; leaf: 1 if matched, else 0."""
        if node.get("all"):
            parts = [self.score(n) for n in node["all"]]
            return sum(parts[1:], parts[0]) / len(parts)
        if node.get("any"):
            parts = [self.score(n) for n in node["any"]]
            return F.greatest(*parts) if len(parts) > 1 else parts[0]
        return F.when(F.coalesce(self.match(node), F.lit(False)), 1.0).otherwise(0.0)

    def leaves(self, node: dict) -> list[dict]:
        return [x for n in node.get("all", node.get("any", [])) for x in self.leaves(n)] if "all" in node or "any" in node else [node]

    def missing(self, node: dict) -> Column:
        """The sorted names of fields that are missing."""
        names = sorted({x["field"] for x in self.leaves(node) if x.get("field") in self.fields})
        return F.array_compact(F.array(*[F.when(self.fields[n].isNull(), n) for n in names])) if names else F.array().cast("array<string>")

    def invalid(self, node: dict) -> bool:
        return any(self._leaf(x) is None for x in self.leaves(node))

    def status(self, node: dict) -> Column:
        m = self.match(node)
        undecided = "invalid" if self.invalid(node) else "missing"
        return F.when(m, "matched").when(~m, "not_matched").otherwise(undecided)


def decide(records: DataFrame, rules: list[Rule], fields: dict[str, Column], candidates: str, key: str, least_score: float = 0.5) -> DataFrame:
    """One decision per record: exact rules first, then partial scores, else what is missing.

    ``candidates``: array column of rule ids that apply.  Returns key, priority, level, confidence, method,
    rule_ids (sorted) and missing.
    """
    c = Compiler(fields)
    rows = [
        F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.level).alias("level"), F.lit(r.priority).alias("priority"),
            F.array_contains(candidates, r.rule_id).alias("applies"), F.coalesce(c.match(r.tree), F.lit(False)).alias("hit"),
            F.coalesce(c.score(r.tree), F.lit(0.0)).alias("score"), F.size(c.missing(r.tree)).alias("n_missing"), c.missing(r.tree).alias("missing"),
        )
        for r in rules
    ]
    d = records.select("*", F.filter(F.array(*rows), lambda x: F.coalesce(x["applies"], F.lit(False))).alias("_rules"))
    d = d.withColumn("_exact", F.filter("_rules", lambda x: x["hit"]))
    best = F.array_max(F.transform("_rules", lambda x: x["score"]))
    d = d.withColumn("_best", best)
    d = d.withColumn("_top", F.filter("_rules", lambda x: F.abs(x["score"] - F.col("_best")) < 1e-9))
    d = d.withColumn("_fewest", F.array_min(F.transform("_top", lambda x: x["n_missing"])))
    d = d.withColumn("_dominant", F.filter("_top", lambda x: x["n_missing"] == F.col("_fewest")))
    n = lambda a: F.size(F.array_distinct(F.transform(a, lambda x: x["priority"])))
    method = (
        F.when(F.size(F.coalesce(candidates, F.array().cast("array<string>"))) == 0, "no_patient_motif")
        .when(F.size("_rules") == 0, "unsupported_protocol_rule")
        .when((F.size("_exact") > 0) & (n("_exact") > 1), "exact_rule_conflict")
        .when(F.size("_exact") == 1, "exact_rule")
        .when(F.size("_exact") > 1, "exact_rule_convergence")
        .when((F.col("_best") < least_score) & F.exists("_rules", lambda x: x["n_missing"] > 0), "missing_required_field")
        .when(F.col("_best") < least_score, "no_matching_criterion")
        .when(F.size("_top") == 1, "deterministic_unique")
        .when(n("_top") == 1, "deterministic_same_priority")
        .when(F.size("_dominant") == 1, "deterministic_evidence_dominance")
        .when(n("_dominant") == 1, "deterministic_multi_evidence_dominance")
        .otherwise("deterministic_priority_conflict")
    )
    d = d.withColumn("method", method)
    used = F.when(F.col("method").startswith("exact"), F.col("_exact")).when(F.col("method").contains("dominance"), F.col("_dominant")).when(F.col("method").startswith("deterministic"), F.col("_top"))
    d = d.withColumn("_used", F.coalesce(used, F.slice("_rules", 1, 0)))
    decided = ~F.col("method").contains("conflict") & (F.size("_used") > 0)
    one = lambda f: F.when(decided, F.get("_used", F.lit(0))[f])
    confidence = F.when(F.col("method").startswith("exact") & decided, 1.0).when(decided, F.col("_best")).otherwise(0.0)
    missing = F.array_sort(F.array_distinct(F.flatten(F.transform("_rules", lambda x: x["missing"]))))
    return d.select(key, one("priority").alias("priority"), one("level").alias("level"), confidence.alias("confidence"), F.col("method"),
                    F.array_sort(F.array_distinct(F.transform("_used", lambda x: x["rule_id"]))).alias("rule_ids"), F.when(F.col("method") == "missing_required_field", missing).otherwise(F.array().cast("array<string>")).alias("missing"))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.80, "high").when(score >= 0.55, "medium").otherwise("low")


def resolve_references(refs: DataFrame, key: str) -> DataFrame:
    """Knowledge references (key, rule_id, resolved: boolean, priorities: array<int>) to one row per key.

    All resolved: unanimity decides, else conflict.  Otherwise reviews: full convergence, a common
    priority, or a resolved one that all allow; else conflict.
    """
    g = refs.groupBy(key).agg(F.collect_list(F.struct("resolved", "priorities")).alias("r"), F.array_sort(F.collect_set("rule_id")).alias("rule_ids"))
    sets = F.filter(F.transform("r", lambda x: x["priorities"]), lambda p: F.size(p) > 0)
    g = g.withColumn("sets", sets).withColumn("all_resolved", F.forall("r", lambda x: x["resolved"]))
    none = F.array().cast("array<int>")
    g = g.withColumn("u", F.array_sort(F.aggregate("sets", none, lambda a, x: F.array_union(a, x))))
    g = g.withColumn("common", F.array_sort(F.aggregate("sets", F.col("u"), lambda a, x: F.array_intersect(a, x))))
    firm = F.array_distinct(F.flatten(F.transform(F.filter("r", lambda x: x["resolved"]), lambda x: x["priorities"])))
    g = g.withColumn("firm", F.array_sort(firm))
    dominant = (F.size("firm") == 1) & F.forall("sets", lambda s: F.array_contains(s, F.get("firm", F.lit(0))))
    method = (
        F.when(F.col("all_resolved") & (F.size("u") == 1), "knowledge_reference")
        .when(F.col("all_resolved"), "knowledge_priority_conflict")
        .when(F.size("sets") == 0, "knowledge_review_required")
        .when(F.size("u") == 1, "knowledge_full_convergence_review")
        .when(F.size("common") == 1, "knowledge_common_priority_review")
        .when(dominant, "knowledge_resolved_dominance_review")
        .otherwise("knowledge_priority_conflict")
    )
    g = g.withColumn("method", method)
    candidates = F.when(F.col("method").isin("knowledge_common_priority_review"), F.col("common")).when(F.col("method") == "knowledge_resolved_dominance_review", F.col("firm")).otherwise(F.col("u"))
    return g.select(key, "method", F.when(F.col("method") == "knowledge_reference", F.get("u", F.lit(0))).alias("priority"), F.array_join(candidates.cast("array<string>"), ",").alias("candidates"), F.array_join("rule_ids", ",").alias("rule_ids"))


def route(excluded: Column, schema_error: Column, private: Column, conflict: Column, evidence: Column, patient_motif: Column, knowledge_motif: Column, knowledge: Column, information: Column) -> Column:
    """struct(route, reason) of the first case that applies."""
    case = lambda r, why: F.struct(F.lit(r).alias("route"), F.lit(why).alias("reason"))
    return (
        F.when(excluded, case("triage_rejected", "HUMAN_EXCLUSION"))
        .when(schema_error, case("triage_rejected", "SCHEMA_ERROR"))
        .when(private, case("human_review", "PRIVACY_REVIEW_REQUIRED"))
        .when(conflict, case("human_review", "CLINICAL_CONFLICT"))
        .when(evidence & patient_motif, case("protocol_annotation", "PATIENT_AND_FRENCH_EVIDENCE"))
        .when(evidence & knowledge_motif, case("human_review", "PATIENT_WITH_KNOWLEDGE_MOTIF_ONLY"))
        .when(evidence, case("human_review", "PATIENT_WITHOUT_FRENCH_MOTIF"))
        .when(knowledge & knowledge_motif, case("controlled_synthesis", "MEDICAL_KNOWLEDGE_AND_FRENCH_MOTIF"))
        .when(knowledge, case("controlled_synthesis", "MEDICAL_KNOWLEDGE_AVAILABLE"))
        .when(patient_motif | knowledge_motif, case("human_review", "FRENCH_MOTIF_WITHOUT_PATIENT_EVIDENCE"))
        .when(information, case("human_review", "MEDICAL_INFORMATION_WITHOUT_TRIAGE_TARGET"))
        .otherwise(case("triage_rejected", "NO_USABLE_TRIAGE_INFORMATION"))
    )
