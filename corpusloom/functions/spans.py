"""Pattern matches that need their places in the text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

NEGATION = re.compile(r"\b(?:no|not|without|denies|pas|sans|aucun|aucune|ni)\b[^.;]*$", re.IGNORECASE)
TITLE = re.compile(r"\b(?:M\.|Mr\.?|Mme|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s*$")


def not_negated(pattern: str, reach: int = 50):
    """A function of a text column: matches of ``pattern`` without a negation in the ``reach`` characters before."""
    compiled = re.compile(pattern, re.IGNORECASE)

    @pandas_udf(ArrayType(StringType()))
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[m[0] for m in compiled.finditer(t or "") if not NEGATION.search(t[max(0, m.start() - reach) : m.start()])] for t in texts])

    return found


def signed_state(positive: list[str], negative: list[str]):
    """PRESENT, ABSENT or UNKNOWN: positive spans inside a negative span do not count; both sides left is UNKNOWN."""
    yes, no = ([re.compile(p, re.IGNORECASE) for p in ps] for ps in (positive, negative))

    def state(t: str | None) -> str:
        t = t or ""
        bad = [m.span() for p in no for m in p.finditer(t)]
        good = [m.span() for p in yes for m in p.finditer(t) if not any(a <= m.start() and m.end() <= b for a, b in bad)]
        return "PRESENT" if good and not bad else "ABSENT" if bad and not good else "UNKNOWN"

    @pandas_udf(StringType())
    def states(texts: pd.Series) -> pd.Series:
        return pd.Series([state(t) for t in texts])

    return states


@pandas_udf(ArrayType(StringType()))
def person_candidates(texts: pd.Series) -> pd.Series:
    """Capitalized names of two words or more, or of one word after a title."""
    name = re.compile(r"\b[A-ZÀ-Ý][\w'-]+(?:\s+[A-ZÀ-Ý][\w'-]+)*")
    return pd.Series([[m[0] for m in name.finditer(t or "") if len(m[0].split()) >= 2 or TITLE.search(t[max(0, m.start() - 40) : m.start()])] for t in texts])
