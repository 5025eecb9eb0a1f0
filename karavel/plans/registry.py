"""All registered queries and their checking statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from karavel.plans import checks_load, checks_ops, checks_source, checks_verify
from karavel.plans.fixtures import Tables, with_views

ALL = {**checks_source.CHECKS, **checks_load.CHECKS, **checks_verify.CHECKS, **checks_ops.CHECKS}


def _bind(f: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: f(Tables(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(f) for name, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in ALL.items() if sql}
