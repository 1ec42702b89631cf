"""Registered queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Source, with_views

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a ``Source`` under its name."""

    def add(f: Callable[[Source], DataFrame]) -> Callable[[Source], DataFrame]:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(Source(spark, sf_dir))
        if sql:
            _SQL[f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import agreement_queries, dataset_queries, match_queries, model_queries, profile_queries, release_queries, scalar_queries, survival_queries, validate_queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
