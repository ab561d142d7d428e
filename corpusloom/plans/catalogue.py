"""All registered queries outside the corpus operators, with their SQL."""

from __future__ import annotations

from . import audit, chats, clinical, curation, dedup, enrichment, evaluation, knowledge, monitoring, more, quality, selection, semantic, signs, tables  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
