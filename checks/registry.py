"""All checks by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics_checks, match_checks, table_checks, text_checks, view_checks
from .fixtures import Tables

ALL = {
    **match_checks.CHECKS,
    **view_checks.CHECKS,
    **analytics_checks.CHECKS,
    **text_checks.CHECKS,
    **table_checks.CHECKS,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build: Callable[[Tables], DataFrame]):
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bind(build) for name, (build, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in ALL.items() if text is not None}
