"""All queries of the replication engine."""

from __future__ import annotations

from .plans import coordination, more, outputs, service  # noqa: F401  (add their queries)
from .plans.queries import ORACLES, QUERIES, flagship

__all__ = ["flagship", "oracle_sql", "queries"]


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
