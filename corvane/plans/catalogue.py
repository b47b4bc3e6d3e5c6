"""All named queries of the engine with the SQL they are checked against."""

from __future__ import annotations

from corvane.plans import corpus, relational  # noqa: F401  they register their queries
from corvane.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
