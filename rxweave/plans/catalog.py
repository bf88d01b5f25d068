"""All queries of the library by name."""

from __future__ import annotations

from . import analysis, checker, evaluation, examples, extraction, fields, knowledge, lexicon, links, names, notes, prediction, review, scoring, sources, storage, texts  # noqa: F401  they register their queries
from .registry import ORACLES, QUERIES

FLAGSHIP = "q_report"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
