"""Operators of a training-data pipeline; ``queries()`` and ``oracle_sql()`` list their checks."""

from memspark.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
