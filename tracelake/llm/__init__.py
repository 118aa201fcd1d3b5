"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries`` and ``oracle_sql`` are
picked up by the driver entry file when the subpackage is present.
"""

from tracelake.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
