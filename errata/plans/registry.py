"""Query registry: name -> (spark, sf_dir) -> DataFrame, plus oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        _QUERIES[name] = fn
        return fn
    return deco


def queries() -> dict[str, QueryFn]:
    from errata.plans import catalog  # noqa: F401  (registers everything)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from errata.plans import catalog  # noqa: F401
    from errata.plans.oracle import QUERIES_SQL
    return {k: v for k, v in QUERIES_SQL.items() if k in _QUERIES}
