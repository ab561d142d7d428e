"""Quality rules: a learned decision list over text statistics, in Spark expressions only.

``text_statistics`` computes statistics of whole texts with built-in functions.
``learn_rules`` is sequential covering with growing and pruning (separate and conquer):
each rule is a conjunction of thresholds for "low quality", grown on two thirds of a bounded,
seeded sample of labelled statistics and pruned on the rest; rules that are not precise enough
on the pruning part end the list.  ``rules_column`` turns the list into one ordered CASE.

Defined results: a null or wordless text has zero words and fails the base rule; documents
without a label are only judged; without labelled rows of both classes the list is empty and
keeps all; repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WORD_SPACE, materialize

#: Symbols counted by ``n_symbols``.
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "line_words", "distinct_share", "upper_share", "digit_share", "stop_share"]


def let(value: Column, body) -> Column:
    """body(value) with ``value`` computed once (a lambda variable is not inlined)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(hashes: Column, width: int) -> Column:
    """Words in windows of ``width`` that occur twice or more, from the array of word hashes."""
    def windows(h: Column) -> Column:
        cut = F.sequence(F.lit(0), F.size(h) - width)
        return F.transform(cut, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))

    def covered(win: Column) -> Column:
        pairs = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def hits(p: Column) -> Column:
            same = lambda x, j: F.coalesce(F.get(p, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(p, same), lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda x, j: F.coalesce(F.least(F.lit(width), F.get(at, j + 1) - x), F.lit(width))), F.lit(0), lambda a, x: a + x)

        return let(let(pairs, hits), total)

    whole = let(windows(hashes), lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), covered(win)).otherwise(0))
    return F.when(F.size(hashes) <= width, F.lit(0)).otherwise(whole)


def text_statistics(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` plus the statistics of each whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, WORD_SPACE), lambda w: w != "")

    def of(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        return let(h, lambda h: F.struct(
            F.size(h).cast("long").alias("n_words"),
            repeated_words(h, 8).cast("long").alias("n_repeat_words"),
            F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
        ))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    s = docs.select(*carry, let(words, of).alias("w"), line.alias("l"), F.length(text).cast("long").alias("chars"), count(r"[\x20\x09-\x0D]").alias("spaces"), count(SYMBOLS).alias("n_symbols"), count("[A-Z]").alias("upper"), count("[0-9]").alias("digits"), count(r"[.,;:!?]").alias("stops"))
    return s.select(*carry, "w.*", "l.*", (F.col("chars") - F.col("spaces")).alias("word_chars"), "n_symbols", "upper", "digits", "stops")


def feature_columns() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "line_words": per("n_words", "n_lines"),
        "distinct_share": per("n_distinct", "n_words"),
        "upper_share": per("upper", "word_chars"),
        "digit_share": per("digits", "word_chars"),
        "stop_share": per("stops", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # True: feature >= cut; False: feature <= cut
    cut: float

    def holds(self, row: dict) -> bool:
        return row[self.feature] >= self.cut if self.above else row[self.feature] <= self.cut

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] >= self.cut if self.above else of[self.feature] <= self.cut


def _covered(rows: list[dict], rule: list[Condition]) -> list[dict]:
    return [r for r in rows if all(c.holds(r) for c in rule)]


def _precision(rows: list[dict]) -> tuple[int, int]:
    return sum(1 for r in rows if r["low"]), len(rows)


def _best_condition(rows: list[dict]) -> tuple[float, Condition | None]:
    """The threshold with the highest FOIL gain."""
    from math import log2

    p, n = _precision(rows)
    best, found = 0.0, None
    base = log2((p + 1) / (n + 2))
    for f in FEATURES:
        order = sorted(rows, key=lambda r: r[f])
        seen = hit = 0
        for a, b in zip(order, [*order[1:], None], strict=True):
            seen, hit = seen + 1, hit + a["low"]
            if b is None or a[f] == b[f]:
                continue
            cut = (a[f] + b[f]) / 2
            for above, k, m in ((False, hit, seen), (True, p - hit, n - seen)):
                gain = k * (log2((k + 1) / (m + 2)) - base)
                if gain > best + 1e-12:
                    best, found = gain, Condition(f, above, cut)
    return best, found


def learn_rules(rows: list[dict], *, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 5) -> list[list[Condition]]:
    """An ordered list of conjunctions that predict ``low``; rows hold FEATURES and ``low``."""
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    rules: list[list[Condition]] = []
    while len(rules) < max_rules and any(r["low"] for r in grow):
        rule: list[Condition] = []
        rest = grow
        while len(rule) < max_conditions and not all(r["low"] for r in rest):
            _, c = _best_condition(rest)
            if c is None:
                break
            rule.append(c)
            rest = _covered(rest, [c])
        if not rule:
            break

        def worth(r: list[Condition]) -> float:
            p, n = _precision(_covered(prune, r))
            return (2 * p - n) / n if n else -1.0

        while len(rule) > 1:
            shorter = max(([*rule[:i], *rule[i + 1 :]] for i in range(len(rule))), key=worth)
            if worth(shorter) < worth(rule):
                break
            rule = shorter
        p, n = _precision(_covered(grow, rule) + _covered(prune, rule))
        pp, pn = _precision(_covered(prune, rule))
        if n < min_cover or p < min_precision * n or (pn and pp < min_precision * pn):
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r) for c in rule)]
    return rules


def rules_column(rules: list[list[Condition]]) -> Column:
    """0 if no rule fires, else the 1-based place of the first that does."""
    of, out = feature_columns(), None
    for i, rule in enumerate(rules, 1):
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        out = F.when(test, i) if out is None else out.when(test, i)
    return F.lit(0) if out is None else out.otherwise(0)


def judge_quality(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 3000, seed: int = 8, **learning) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (0: none) and ``kept`` of every document.

    ``sample_rows`` bounds the labelled sample (the least seeded hashes of doc_id); the
    list is learned from it on the driver.  Of labels that repeat a doc_id the least quality counts.
    """
    stats = materialize(text_statistics(docs, ["doc_id"]))
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample_rows)
    features = feature_columns()
    taught = stats.join(F.broadcast(known), "doc_id").select("doc_id", (F.col("quality") == 0).alias("low"), *[c.alias(k) for k, c in features.items()])
    taught = taught.groupBy("doc_id").agg(F.min(F.struct("low", *features)).alias("row"))  # one row of repeated doc_ids
    rows = [{"doc_id": r["doc_id"]} | r["row"].asDict() for r in taught.collect()]
    rows.sort(key=lambda r: ((r["doc_id"] * 0x9E3779B97F4A7C15) % 2**64, *[r[f] for f in FEATURES]))
    rules = learn_rules(rows, **learning)
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.withColumn("base_failed", base).withColumn("rule", rules_column(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
