"""Synthetic candles: a sine-wave series in closed form, and a random walk from a linear congruential generator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.schema import CANDLE

# Fixed values of the generators.
LCG_MUL, LCG_ADD = 6_364_136_223_846_793_005, 1_442_695_040_888_963_407
START_PRICE, START_TS, MINUTE = 50_000.0, 1_700_000_000_000, 60_000
MASK = (1 << 64) - 1


def sine_candles(spark: SparkSession, n: int, symbol: str = "BTCUSDT:1m") -> DataFrame:
    """n minute candles of one symbol. The price is a running sum, so n is meant for tests and demos."""
    i = F.col("id").cast("double")
    step = F.sin(i * 0.08) * 500.0 * 0.1 + (F.sin(i * 1.7) * 100.0 + F.cos(i * 3.1) * 50.0) * 0.05
    price = START_PRICE + F.sum("step").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    rows = spark.range(n).withColumn("step", step).withColumn("open", price)
    p = F.col("open")
    return rows.select(
        F.col("id").alias("seq"),
        F.lit(symbol).alias("symbol"),
        (F.lit(START_TS) + F.col("id") * MINUTE).alias("ts"),
        "open",
        (p + p * 0.002).alias("high"),
        (p - p * 0.002).alias("low"),
        (p + F.sin(i * 2.3) * p * 0.001).alias("close"),
        (F.abs(F.sin(i * 0.5)) * 5.0 + 10.0).alias("volume"),
    )


def walk_candles(spark: SparkSession, n: int, symbol: str = "SIM:1s", seed: int = 42, price: float = START_PRICE) -> DataFrame:
    """n candles of a multiplicative walk. Each state of the generator follows from the one before, on the driver."""
    rows, full = [], float((1 << 32) - 1)
    for i in range(n):
        seed = (seed * LCG_MUL + LCG_ADD) & MASK
        high_bits, low_bits = (seed >> 32) / full, (seed & 0xFFFFFFFF) / full
        close = max(price * (1.0 + (high_bits * 0.003 - 0.0015)), 1.0)
        high, low = max(price, close) * (1.0 + high_bits * 0.001), min(price, close) * (1.0 - low_bits * 0.001)
        rows.append((i, symbol, START_TS + i * 1000, price, high, low, close, 0.5 + high_bits * 2.0))
        price = close
    return spark.createDataFrame(rows, CANDLE)
