"""Summaries of series and order statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.ordered import numbered


def series_summary(candles: DataFrame) -> DataFrame:
    """Per symbol: candles, mean close, first and last ts and close by arrival, span, lowest low, highest high. Missing closes are passed over."""
    closed = F.when(F.col("close").isNotNull(), F.col("seq"))
    made = candles.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("candles"),
        (F.sum(F.round(F.col("close") * 100_000_000).cast("long")).cast("double") / (F.count(F.lit(1)) * 1e8)).alias("mean_close"),
        F.min_by("ts", "seq").alias("first_ts"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.min_by("close", closed).alias("first_close"),
        F.max_by("close", closed).alias("last_close"),
        F.min("low").alias("lowest"),
        F.max("high").alias("highest"),
    )
    return made.withColumn("span", F.col("last_ts") - F.col("first_ts"))


def latency_percentiles(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """Per keys: n, lowest, mean (integer division), p50, p99, p999, highest of a whole-numbered column.

    A percentile is the value at place floor(n * share), from 0, in ascending order. `tie` makes the order unique. No
    task sorts more than a range of the values of a key.
    """
    placed = numbered(rows.where(F.col(value).isNotNull()), keys, [value, tie], "_n")
    sizes = placed.groupBy(*keys).agg(F.max("_n").alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    at = {"p50": F.expr("n div 2"), "p99": F.expr("n * 99 div 100"), "p999": F.expr("n * 999 div 1000")}
    picked = placed.join(sizes.select(*keys, *(a.alias(f"_{p}") for p, a in at.items())), keys)
    picked = picked.where(" OR ".join(f"_n = _{p} + 1" for p in at)).groupBy(*keys).agg(*(F.max(F.when(F.col("_n") == F.col(f"_{p}") + 1, F.col(value))).alias(p) for p in at))
    return sizes.join(picked, keys).select(*keys, "n", "lowest", F.expr("total div n").alias("mean"), *at, "highest")
