"""Further lexicon terms of rules, taken from the text conditions of their automation trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.fixed_knowledge import ALIAS_EXCLUDED, LANGUAGE_MARKERS

VOCABULARY = "rule_id string, lang string, term string, keyword boolean"
TERMS = "rule_id string, term string"


def vocabulary(spark: SparkSession, protocol: dict) -> DataFrame:
    """(rule_id, lang, term, keyword): names and keywords of the rules of a protocol, trimmed, in lower case."""
    rows = []
    for m in protocol.get("motifs", []):
        if not m.get("rule_id"):
            continue
        for lang in ALIAS_EXCLUDED:
            names = [((m.get("motif") or {}).get(lang), False)] + [(k, True) for k in (m.get("keywords") or {}).get(lang) or []]
            rows += [(str(m["rule_id"]), lang, str(t).strip().lower(), is_key) for t, is_key in names if t]
    return spark.createDataFrame(rows, VOCABULARY)


def condition_terms(spark: SparkSession, protocol: dict) -> DataFrame:
    """(rule_id, term): the terms of conditions that seek any of them in the text, each once."""
    rows, open_nodes = set(), []
    for m in protocol.get("motifs", []):
        levels = (m.get("triage_levels") or {}).values()
        open_nodes += [(str(m["rule_id"]), spec.get("automation")) for spec in levels if m.get("rule_id") and isinstance(spec, dict)]
    while open_nodes:
        rule, node = open_nodes.pop()
        if isinstance(node, list):
            open_nodes += [(rule, child) for child in node]
        elif isinstance(node, dict):
            if (node.get("field"), node.get("operator")) == ("text", "contains_any"):
                rows |= {(rule, str(t).strip()) for t in node.get("value") or []}
            open_nodes += [(rule, node.get("all")), (rule, node.get("any"))]
    return spark.createDataFrame(sorted(r for r in rows if r[1]), TERMS)


def aliases(terms: DataFrame, known: DataFrame) -> DataFrame:
    """(rule_id, lang, term): terms that the rule does not have in any language, that are not too general and that show
    their language; one that shows both stands in both. The rows are a lexicon for ``lexicon_matches``."""
    low = F.lower("term")
    shown = lambda lang: F.coalesce(*[F.when(F.contains(low, F.lit(m)), True) for m in LANGUAGE_MARKERS[lang]], F.lit(False))
    fits = F.array_compact(F.array(*[F.when(shown(lang) & ~low.isin(words), lang) for lang, words in ALIAS_EXCLUDED.items()]))
    rest = terms.withColumn("_low", low).join(known.select("rule_id", F.col("term").alias("_low")), ["rule_id", "_low"], "left_anti")
    return rest.select("rule_id", F.explode(fits).alias("lang"), "term")


def unknown_rules(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule ids of aliases that no rule has; there must be none."""
    return found.select("rule_id").distinct().join(rules.select("rule_id"), "rule_id", "left_anti")


def repeated_keywords(found: DataFrame, known: DataFrame) -> DataFrame:
    """Aliases that are a keyword of their rule and language already."""
    keys = known.where("keyword").select("rule_id", "lang", F.col("term").alias("_low"))
    return found.withColumn("_low", F.lower("term")).join(keys, ["rule_id", "lang", "_low"], "left_semi").drop("_low")
