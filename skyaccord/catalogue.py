"""All queries of the library by name, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skyaccord.plans import imaging, matching, positions, reports, scalars, visibility

_MODULES = (matching, visibility, imaging, reports, scalars, positions)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for m in _MODULES for name, (_, text) in m.QUERIES.items() if text}
