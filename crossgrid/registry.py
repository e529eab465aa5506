"""All queries of the engine by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries as _plans
from .plans import reports as _reports  # noqa: F401  (adds its queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_plans.QUERIES)


def oracles() -> dict[str, str]:
    return dict(_plans.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A formula from parsing to its information coefficients on the validation years."""
    return _plans.ic_summary(spark, sf_dir)
