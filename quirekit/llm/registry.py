"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from . import queries as q


@cache
def _all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in vars(q).items() if name.startswith("op") and callable(f)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_all())


def oracle_sql() -> dict[str, str]:
    return dict(q.ORACLE_SQL)
