"""Registered queries of the retrieval engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evidara.plans import analysis_queries, record_queries, retrieval_queries, source_queries, storage_queries  # noqa: F401  (they register)
from evidara.plans.views import REGISTERED, plain


def _plainly(f):
    return lambda spark, sf_dir: plain(f(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _plainly(f) for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTERED.items() if sql}
