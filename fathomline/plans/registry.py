"""All queries and their SQL, filled by the modules of this package as they are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Added before rounding where exact ties are common, which engines round to different sides.
OFF_TIES = 0.000013


def query(sql: str | None):
    """Registers a function (spark, folder) under its name, with its SQL if there is one."""

    def keep(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep
