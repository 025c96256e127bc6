"""Row types of the market-data model. Spark timestamps hold microseconds, so ts stays a LONG of the caller's unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _required(*fields: tuple[str, type]) -> list[StructField]:
    return [StructField(name, kind(), False) for name, kind in fields]


FIELDS = ("open", "high", "low", "close", "volume")
#: A cold file holds these columns; the symbol is its folder.
BAR = StructType(_required(("ts", LongType), *((f, DoubleType) for f in FIELDS)))
#: seq is the order of arrival, which a DataFrame does not have by itself.
CANDLE = StructType([*_required(("seq", LongType), ("symbol", StringType)), *BAR.fields])
ORDER = StructType(
    [*_required(("seq", LongType), ("symbol", StringType), ("side", StringType), ("kind", StringType)), StructField("price", DoubleType()), *_required(("qty", DoubleType), ("ts", LongType))]
)
SIGNAL = StructType(_required(("seq", LongType), ("ts", LongType), ("symbol", StringType), ("side", StringType), ("qty", DoubleType), ("price", DoubleType), ("strategy", IntegerType)))
#: Fills and cancels of an order book or paper engine in one table; columns that do not apply are null.
TRADE_EVENT = StructType(
    [
        StructField("seq", LongType()),
        StructField("ord", IntegerType()),
        StructField("event", StringType()),
        StructField("order_id", LongType()),
        StructField("symbol", StringType()),
        StructField("side", StringType()),
        StructField("price", DoubleType()),
        StructField("qty", DoubleType()),
        StructField("ts", LongType()),
        StructField("reason", StringType()),
    ]
)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NaN nor infinite; false for null."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def is_valid() -> Column:
    """A candle is valid if ts is not negative and all five numbers are finite; nothing is said of their order or sign."""
    valid = F.coalesce(F.col("ts") >= 0, F.lit(False))
    for field in FIELDS:
        valid &= is_finite(F.col(field))
    return valid


def first_fault() -> Column:
    """The name of the first column that makes a candle invalid, null for a valid one."""
    fault = F.when(~F.coalesce(F.col("ts") >= 0, F.lit(False)), "ts")
    for field in FIELDS:
        fault = fault.when(~is_finite(F.col(field)), field)
    return fault
