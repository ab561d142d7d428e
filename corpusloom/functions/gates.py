"""What must stand in a text before a pattern can match: plain strings that are sought first, since most texts have none."""

from __future__ import annotations

import re
from functools import cache
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that patterns without letter case take for a plain one, beyond what lower case does.
ODD_CASE, PLAIN_CASE = "İıſ", "iis"


def _needed(nodes) -> set[str] | None:
    """Strings of which each match has at least one; None where nothing is certain."""
    found, run = [], ""
    for op, arg in [*nodes, (None, None)]:
        if op is ops.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            found.append({run})
            run = ""
        if op is ops.SUBPATTERN:
            found.append(_needed(arg[-1]))
        elif op is ops.BRANCH:
            parts = [_needed(b) for b in arg[1]]
            found.append(None if None in parts else set().union(*parts))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] > 0:
            found.append(_needed(arg[2]))
    return max((f for f in found if f), key=lambda f: (min(map(len, f)), -len(f)), default=None)


@cache
def needed(pattern: str) -> tuple[str, ...] | None:
    """Lower-case strings; a text in lower case without any of them has no match of ``pattern``, letter case aside."""
    found = _needed(parser.parse(pattern, re.IGNORECASE))
    return None if found is None else tuple(sorted(w for w in found if not any(v != w and v in w for v in found)))


def plain_case(text: str) -> str:
    for odd, plain in zip(ODD_CASE, PLAIN_CASE, strict=True):
        text = text.replace(odd, plain)
    return text.lower()


def lowered(text: Column) -> Column:
    for odd, plain in zip(ODD_CASE, PLAIN_CASE, strict=True):  # plain searches, where a translation looks up every character
        text = F.replace(text, F.lit(odd), F.lit(plain))
    return F.lower(text)


def once(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def may_match(low: Column, patterns: list[str]) -> Column:
    """Whether a text in lower case has what one of the patterns needs."""
    words = [needed(p) for p in patterns]
    if None in words:
        return F.lit(True)
    tests = [F.contains(low, F.lit(w)) for w in sorted({w for ws in words for w in ws})]
    while len(tests) > 1:  # a balanced tree: long chains nest too deep
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return tests[0]


def all_matches(text: Column, patterns: list[str], flags: str, part: int = 1) -> Column:
    """What a group of the patterns matches, pattern by pattern; null for a null text."""
    none = F.array().cast("array<string>")
    found = lambda low, p: F.when(may_match(low, [p]), F.regexp_extract_all(text, F.lit(flags + p), F.lit(part))).when(text.isNotNull(), none)
    return once(lowered(text), lambda low: F.flatten(F.array(*[found(low, p) for p in patterns])))


def matches_any(text: Column, patterns: list[str], flags: str) -> Column:
    """Whether one of the patterns is in the text; null for a null text."""
    return once(lowered(text), lambda low: may_match(low, patterns) & text.rlike(flags + "|".join(patterns)))
