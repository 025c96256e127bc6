"""Candles, ticks, orders and signals as views of an events table (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def ticks(given: DataFrame, symbol: str = "event_type") -> DataFrame:
    """Each event as a candle of its own, in order of event_id."""
    value = F.col("value")
    return given.select(
        F.col("event_id").alias("seq"),
        F.col(symbol).cast("string").alias("symbol"),
        micros(F.col("ts")).alias("ts"),
        *(value.alias(c) for c in ("open", "high", "low", "close")),
        F.lit(1.0).alias("volume"),
    )


def bars(given: DataFrame, width: int = HOUR) -> DataFrame:
    """Events resampled to candles of `width` microseconds; seq is the number of the interval, last_event the latest event_id.

    An event without a value counts in volume and last_event, but is no price.
    """
    at = micros(F.col("ts"))
    place = F.when(F.col("value").isNotNull(), F.struct("at", "event_id"))
    bar = given.withColumn("at", at).withColumn("seq", F.floor(F.col("at") / width).cast("long")).groupBy(F.col("event_type").alias("symbol"), "seq")
    made = bar.agg(
        F.min_by("value", place).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", place).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.max("event_id").alias("last_event"),
    )
    return made.select("seq", "symbol", (F.col("seq") * width).alias("ts"), "open", "high", "low", "close", "volume", "last_event")


def orders(given: DataFrame) -> DataFrame:
    """An order for each event: side by user, kind by turns (FOK where event_id is negative and no multiple of 4), market orders without price."""
    kinds = F.array(*map(F.lit, ("LIMIT", "MARKET", "IOC", "FOK")))
    kind = F.coalesce(F.get(kinds, (F.col("event_id") % 4).cast("int")), F.lit("FOK"))
    return given.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "B").otherwise("S").alias("side"),
        kind.alias("kind"),
        F.when(kind != "MARKET", F.col("value")).alias("price"),
        (1 + F.col("user_id") % 5).cast("double").alias("qty"),
        micros(F.col("ts")).alias("ts"),
    )


def signals(given: DataFrame) -> DataFrame:
    """A signal for each event; quantities from 0 to 11, so that some are refused."""
    return given.select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("symbol"),
        F.when(F.col("user_id") % 2 == 0, "B").otherwise("S").alias("side"),
        (F.col("user_id") % 12).cast("double").alias("qty"),
        F.lit(0.0).alias("price"),
        micros(F.col("ts")).alias("ts"),
    )
