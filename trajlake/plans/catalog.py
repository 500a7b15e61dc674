"""The library's registered queries and their SQL."""

from __future__ import annotations

from trajlake.plans import aggregates, curation, exports, files, joins, poses, sequences  # noqa: F401
from trajlake.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
