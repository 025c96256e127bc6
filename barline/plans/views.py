"""The views for SQL users: candles, ticks and orders of an events table, and the scalar functions of the model in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from barline.sources import market

#: name, arguments, type and body of functions that SQL lacks; the same rules as in functions/scalars.py.
FUNCTIONS = (
    ("price_key", "price DOUBLE", "BIGINT", "CAST(round(price * 100000000) AS BIGINT)"),
    ("key_price", "key BIGINT", "DOUBLE", "key / 1e8D"),
    ("store_key", "symbol STRING, span STRING", "STRING", "concat(upper(symbol), ':', span)"),
    ("signed_qty", "side STRING, qty DOUBLE", "DOUBLE", "CASE WHEN side = 'B' THEN qty ELSE -qty END"),
    ("unrealized_pnl", "position DOUBLE, cost DOUBLE, mark DOUBLE", "DOUBLE", "(mark - cost) * position"),
)


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views `ticks`, `bars`, `paper_orders`, `signals`, and temporary functions, for spark.sql."""
    given = market.events(spark, sf_dir)
    for name, df in (("ticks", market.ticks(given)), ("bars", market.bars(given)), ("paper_orders", market.orders(given)), ("signals", market.signals(given))):
        df.createOrReplaceTempView(name)
    for name, arguments, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
