"""Queries of this package's own operators, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundspark.plans import actions, agreement, constraints, graphs, interchange, names, paging, plant, questions, records, tables, timing  # noqa: F401  (they register their queries)
from groundspark.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unit-normalised total over a hierarchy."""
    return tables.t_region_unit_sum(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
