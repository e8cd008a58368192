"""Named queries over the test tables, each with an independent SQL counterpart where SQL can say it."""

from tallyward.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
