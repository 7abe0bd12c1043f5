"""Named queries: each a function of the roles' tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.analog import Tables, with_roles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, after: str = ""):
    """Registers f(tables). sql: SELECT over the roles' names; after: further CTEs before it."""

    def add(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_roles(sql, after)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tallyloom.plans import audits, etl, functions, marts, merges, serving, sourcing  # noqa: F401  they register themselves

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
