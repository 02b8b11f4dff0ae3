"""Every query of the engine and the SQL that says the same."""

from __future__ import annotations

from . import q_compare, q_retrieval, q_scoring, q_store, q_text, q_views, q_write  # noqa: F401  they register themselves
from .domain import ORACLES, QUERIES

flagship = q_compare.flagship


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
