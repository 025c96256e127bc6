"""All queries of the library and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.plans import live, market


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return market.QUERIES | live.QUERIES


def oracle_sql() -> dict[str, str]:
    return market.ORACLES | live.ORACLES
