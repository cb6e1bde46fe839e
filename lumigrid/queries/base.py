"""Registration of queries: a Spark function and, where SQL can express it, the SQL text of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumigrid.plans import corpus as fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Registers a query; ctes are put before its SQL."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (f"WITH {', '.join(ctes)}\n" if ctes else "") + sql.strip()
        return f

    return register


CORPUS = (fixtures.SQL_CORPUS,)
MEMBERS = (fixtures.SQL_CORPUS, fixtures.SQL_MEMBERS)
PIXELS = (fixtures.SQL_PIXELS,)


def k_sql(distance: str) -> str:
    return f"(1 + cos(pi() * least(1.0, greatest(0.0, {distance})))) / 2"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"
