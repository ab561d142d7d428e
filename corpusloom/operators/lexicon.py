"""Lexicon terms in texts by one scan: an automaton of all terms, whole words only.

The terms of all rules go into one trie with failure links, so a text is read once however many terms there
are, and no n-gram of a text is exchanged.  The automaton is built on the driver and sent to every task: the lexicon has at
most ``MOST_TERMS`` terms (checked; ``joins.lexicon_matches`` joins larger ones by an exchange).

Texts and terms are folded alike: NFKD without combining marks, case-folded, other characters than letters, digits
and underscores as one space (``plain``: than a-z and 0-9).
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf

from corpusloom.functions import fixed_lexicon as fixed

MOST_TERMS = 1_000_000
CANDIDATES = "array<struct<rule_id:string,score:double,matched_terms:array<string>,structured_hits:array<string>>>"
MOTIFS = "array<struct<rule_id:string,matched_terms:array<string>>>"
FOUND = pa.list_(pa.struct([("rule_id", pa.string()), ("matched_terms", pa.list_(pa.string()))]))
#: Texts that Python holds at once.
AT_ONCE = 64


def folded(text: str | None, plain: bool = False) -> str:
    if not text:
        return ""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+" if plain else r"[^\w]+", " ", text.casefold()).strip()


class TermIndex:
    """The automaton of a set of folded terms; with ``words`` also of their significant words."""

    def __init__(self, rows: Iterable[tuple[str, str]], *, words: bool = False):
        import ahocorasick

        self.rules: list[list[str]] = []  # of each term
        self.terms: list[str] = []
        at: dict[str, int] = {}
        for rule, term in sorted(set(rows)):
            if term not in at:
                at[term] = len(self.terms)
                self.terms.append(term)
                self.rules.append([])
            self.rules[at[term]].append(rule)
        self.of_word: dict[str, list[int]] = defaultdict(list)
        self.needed: dict[int, int] = {}
        if words:
            for k, term in enumerate(self.terms):
                long = [w for w in term.split() if len(w) >= fixed.LEAST_LETTERS]
                if len(long) >= fixed.LEAST_WORDS:
                    self.needed[k] = len(long)
                    for w, n in Counter(long).items():
                        self.of_word[w] += [k] * n
        self.automaton = ahocorasick.Automaton()
        for term in {*self.terms, *self.of_word}:
            self.automaton.add_word(f" {term} ", (at.get(term), term))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> tuple[set[int], set[int]]:
        """The terms that stand in a folded text as a whole, and those of which enough words do."""
        if not len(self.automaton) or not text:
            return set(), set()
        met = {v for _, v in self.automaton.iter(f" {text} ")}
        whole = {k for k, _ in met if k is not None}
        hits: Counter = Counter()
        for _, term in met:
            hits.update(self.of_word.get(term, ()))
        return whole, {k for k, n in hits.items() if k not in whole and n / self.needed[k] >= fixed.PARTIAL_SHARE}

    def scored(self, text: str, fields: dict[str, str]) -> list[dict]:
        """Rules by falling score: their terms in the text, and the fields that show one of them."""
        whole, partial = self.found(text)
        score: dict[str, float] = defaultdict(float)
        terms: dict[str, list[str]] = defaultdict(list)
        for k in sorted(whole | partial, key=lambda k: self.terms[k]):
            for rule in self.rules[k]:
                score[rule] += fixed.WHOLE_SCORE if k in whole else fixed.PARTIAL_SCORE
                terms[rule].append(self.terms[k])
        hits: dict[str, list[str]] = defaultdict(list)
        for name, value in fields.items():
            for rule in {r for k in set().union(*self.found(value)) for r in self.rules[k]}:
                hits[rule].append(name)
                score[rule] += fixed.FIELD_SCORE
        out = [{"rule_id": r, "score": round(s, 4), "matched_terms": terms.get(r, []), "structured_hits": hits.get(r, [])} for r, s in score.items()]
        return sorted(out, key=lambda c: (-c["score"], c["rule_id"]))

    def motifs(self, text: str) -> list[dict]:
        """Rules with their terms in the text, those with the longest term first."""
        terms: dict[str, list[str]] = defaultdict(list)
        for k in self.found(text)[0]:
            for rule in self.rules[k]:
                terms[rule].append(self.terms[k])
        out = [{"rule_id": r, "matched_terms": sorted(t, key=lambda x: (-len(x), x))} for r, t in terms.items()]
        return sorted(out, key=lambda c: (-len(c["matched_terms"][0]), c["rule_id"]))


def _rows(lexicon: DataFrame) -> list:
    rows = lexicon.select(F.col("rule_id").cast("string"), "lang", "term").where("rule_id is not null and term is not null").limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"the lexicon has over {MOST_TERMS} terms: join it with joins.lexicon_matches")
    return rows


def language_motifs(lexicon: DataFrame, text: Column, lang: Column) -> Column:
    """The rules whose terms of the text's language stand in it: array of (rule_id, matched_terms).

    ``lexicon``: rule_id, lang, term.  Generic terms of a language count for nothing; longer terms go first, then rule ids.  A null
    text or language, or a language without terms, has none.
    """
    by_lang: dict[str, list[tuple[str, str]]] = defaultdict(list)
    for rule, language, term in _rows(lexicon):
        t = folded(term, plain=True)
        if t and t not in fixed.GENERIC_TERMS.get(language, ()):
            by_lang[language].append((rule, t))
    index = {language: TermIndex(rows) for language, rows in by_lang.items()}

    @arrow_udf(MOTIFS)
    def match(texts: pa.Array, langs: pa.Array) -> pa.Array:
        told = lambda k: zip(*(v.slice(k, AT_ONCE).to_pylist() for v in (texts, langs)), strict=True)
        parts = [pa.array([index[language].motifs(folded(t, plain=True)) if language in index else [] for t, language in told(k)], FOUND) for k in range(0, len(texts), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], FOUND)

    return match(text, lang)


def scored_rules(lexicon: DataFrame, text: Column, fields: dict[str, Column]) -> Column:
    """The rules that a text shows, by falling score, then rule id: array of (rule_id, score, matched_terms, structured_hits).

    A term that stands in the text as a whole scores 2, one of two or more longer words of which three quarters
    stand there scores 1, and each field that shows a term of the rule adds a half.  Terms of all languages count; generic ones do not.
    ``fields`` are structured values, which belong to the text as well.  A null text is empty.
    """
    rows = {(rule, t) for rule, _, term in _rows(lexicon) if (t := folded(term)) and t not in fixed.SCORED_GENERIC_TERMS}
    index, names = TermIndex(rows, words=True), list(fields)

    @pandas_udf(CANDIDATES)
    def match(texts: pd.Series, values: pd.DataFrame) -> pd.Series:
        sides = [values.iloc[:, k] for k in range(1, values.shape[1])]
        out = []
        for row in zip(texts, *sides, strict=True):
            held = {n: f for n, v in zip(names, row[1:], strict=True) if v and (f := folded(v))}
            out.append(index.scored(folded(" ".join(v for v in row if v)), held))
        return pd.Series(out)

    return match(text, F.struct(F.lit(0).alias("none"), *[c.cast("string").alias(f"f{i}") for i, c in enumerate(fields.values())]))


def resolved(candidates: Column) -> Column:
    """struct(status, score, margin, candidates) of ``scored_rules``: no_match, weak_match, ambiguous_match or unique_match.

    A unique match leads by a margin and keeps the best rule only; the others keep the first five.
    """
    at = lambda k: F.coalesce(F.get(candidates, F.lit(k))["score"], F.lit(0.0))
    status = (
        F.when(F.size(candidates) == 0, "no_match")
        .when(at(0) < fixed.LEAST_SCORE, "weak_match")
        .when(at(0) - at(1) < fixed.LEAST_MARGIN, "ambiguous_match")
        .otherwise("unique_match")
    )
    shown = F.when(status == "unique_match", 1).otherwise(fixed.SHOWN_CANDIDATES)
    return F.struct(status.alias("status"), at(0).alias("score"), (at(0) - at(1)).alias("margin"), F.slice(candidates, F.lit(1), shown).alias("candidates"))


def recovery_counts(matches: Column) -> list[Column]:
    """Counts over ``resolved`` values: by status, unique ones by whether a structured field shows the rule."""
    best = F.get(matches["candidates"], F.lit(0))
    unique = matches["status"] == "unique_match"
    by_status = [F.count_if(matches["status"] == s).alias(s) for s in ("no_match", "weak_match", "ambiguous_match", "unique_match")]
    return [*by_status, F.count_if(unique & (F.size(best["structured_hits"]) > 0)).alias("unique_with_fields"), F.count_if(unique & (F.size(best["structured_hits"]) == 0)).alias("unique_by_text")]
