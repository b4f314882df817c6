"""All queries: importing their modules registers them."""

from __future__ import annotations

from lociforge.jobs import file_queries, queries, table_queries  # noqa: F401
from lociforge.jobs.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
