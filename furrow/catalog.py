"""The library's registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from furrow.plans import land, learning, satellite  # noqa: F401  they register their queries
from furrow.plans.base import ORACLE_SQL, QUERIES

FLAGSHIP = "t12_quota_allocate"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
