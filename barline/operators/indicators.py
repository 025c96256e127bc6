"""Rolling averages, crossovers and other order-sensitive series, without a task per symbol.

Averages are sums of price keys (units of 1e-8), which are integers, so they do not depend on the order of summation
and comparisons of two averages are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.options import StrategyOptions
from barline.functions.ordered import Spread, framed, numbered, running, spread
from barline.functions.scalars import PRICE_SCALE, price_key


def _mean(total: Column, period: int) -> Column:
    return total.cast("double") / float(period * PRICE_SCALE)


def rolling_sma(candles: DataFrame, period: int, name: str = "sma") -> DataFrame:
    """Adds the mean close of the last `period` candles of the symbol by seq; null until there are so many, or for period 0."""
    if period < 1:
        return candles.withColumn(name, F.lit(None).cast("double"))
    counted = numbered(candles.withColumn("_key", price_key(F.col("close"))), ["symbol"], ["seq"], "_n")

    def made(window: Window) -> dict[str, Column]:
        return {"_sum": F.sum("_key").over(window.rowsBetween(1 - period, 0))}

    summed = framed(counted, ["symbol"], "_n", period - 1, made)
    return summed.withColumn(name, F.when(F.col("_n") >= period, _mean(F.col("_sum"), period))).select(*candles.columns, name)


def accepted(candles: DataFrame, known: Spread | None = None) -> DataFrame:
    """Candles whose ts is above all earlier ones of the symbol; a strategy looks at no others."""
    seen = running(candles, ["symbol"], ["seq"], {"_top": ("max", F.col("ts"))}, known=known)
    return seen.where(F.col("_top").isNull() | (F.col("ts") > F.col("_top"))).drop("_top")


def sma_crossover(candles: DataFrame, short: int = 10, long: int = 20) -> DataFrame:
    """symbol, n, seq, ts, side, short_sma, long_sma of each crossing of two rolling means of closes.

    n is the number of the candle among the accepted ones. Buy where the short mean was not above the long one and now
    is, Sell where it was not below and now is. Nothing is told before candle max(short, long + 1) + 1, nor if a period
    is 0.
    """
    if min(short, long) < 1:
        return candles.limit(0).select("symbol", F.lit(0).cast("long").alias("n"), "seq", "ts", F.lit("").alias("side"), F.lit(0.0).alias("short_sma"), F.lit(0.0).alias("long_sma"))
    lean = candles.select("symbol", "seq", "ts", price_key(F.col("close")).alias("_key"))
    known = spread(lean, ["symbol"])
    counted = numbered(accepted(lean, known), ["symbol"], ["seq"], known=known)

    def made(window: Window) -> dict[str, Column]:
        def total(period: int, back: int) -> Column:
            return F.sum("_key").over(window.rowsBetween(1 - period - back, -back))

        # Both means times both periods, so that integers are compared.
        return {"_s": total(short, 0), "_l": total(long, 0), "_now": total(short, 0) * long - total(long, 0) * short, "_before": total(short, 1) * long - total(long, 1) * short}

    found = framed(counted, ["symbol"], "n", max(short, long), made)
    side = F.when((F.col("_before") <= 0) & (F.col("_now") > 0), "B").when((F.col("_before") >= 0) & (F.col("_now") < 0), "S")
    told = found.where(F.col("n") >= max(short, long + 1) + 1).withColumn("side", side).where("side IS NOT NULL")
    return told.select("symbol", "n", "seq", "ts", "side", _mean(F.col("_s"), short).alias("short_sma"), _mean(F.col("_l"), long).alias("long_sma"))


def strategy_signals(candles: DataFrame, options: StrategyOptions = StrategyOptions()) -> DataFrame:
    """The signals (seq, ts, symbol, side, qty, price, strategy) of the crossover strategy: one for each crossing."""
    found = sma_crossover(candles, options.short, options.long)
    return found.select("seq", "ts", "symbol", "side", F.lit(options.qty).alias("qty"), F.lit(options.price).alias("price"), F.lit(options.strategy).alias("strategy"))


def level_signals(candles: DataFrame, fast: int = 10, slow: int = 20, ties_long: bool = False) -> DataFrame:
    """symbol, n, seq, ts, open, close, side, changed from candle slow + 1 on: whether the fast mean is above the slow one.

    The slow mean is over slow + 1 candles, the candle itself and `slow` before it. side is LONG or SHORT; equal means
    are SHORT, or LONG with ties_long. changed says that it differs from the candle before, or is the first.
    """
    lean = candles.select("symbol", "seq", "ts", "open", "close", price_key(F.col("close")).alias("_key"))
    counted = numbered(lean, ["symbol"], ["seq"])

    def made(window: Window) -> dict[str, Column]:
        def above(back: int) -> Column:
            f = F.sum("_key").over(window.rowsBetween(1 - fast - back, -back))
            s = F.sum("_key").over(window.rowsBetween(-slow - back, -back))
            difference = f * (slow + 1) - s * fast
            return difference >= 0 if ties_long else difference > 0

        return {"_is": above(0), "_was": above(1)}

    found = framed(counted, ["symbol"], "n", slow + 1, made).where(F.col("n") > slow)
    side = F.when(F.col("_is"), "LONG").otherwise("SHORT")
    changed = (F.col("n") == slow + 1) | (F.col("_is") != F.col("_was"))
    return found.select("symbol", "n", "seq", "ts", "open", "close", side.alias("side"), changed.alias("changed"))


def monotonic_ts(rows: DataFrame, keys: list[str], now: str = "ts") -> DataFrame:
    """Adds `out_ts`, a strictly increasing clock: the later of `now` and one more than the value before.

    In closed form: the row number plus the greatest lead of `now` over it so far.
    """
    known = spread(rows, keys)
    counted = numbered(rows, keys, ["seq"], "_n", known=known)
    lead = F.col(now) - F.col("_n")
    seen = running(counted.withColumn("_lead", lead), keys, ["seq"], {"_most": ("max", F.col("_lead"))}, known=known)
    top = F.greatest(F.col("_lead"), F.col("_most"), F.lit(0).cast("long"))
    return seen.withColumn("out_ts", F.col("_n") + top).select(*rows.columns, "out_ts")
