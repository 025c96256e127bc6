"""Closed klines from stream messages in JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.scalars import store_key

KLINE = "struct<data:struct<k:struct<t:bigint,o:string,h:string,l:string,c:string,v:string,x:boolean,s:string,i:string>>>"


def subscription_url(host: str, subscriptions: list[tuple[str, str]]) -> str:
    """The address of a combined stream for (symbol, interval) pairs; there must be one at least."""
    if not subscriptions:
        raise ValueError("no subscriptions")
    return f"wss://{host}/stream?streams=" + "/".join(f"{s.lower()}@kline_{i}" for s, i in subscriptions)


def decode(messages: DataFrame, text: Column | str = "value") -> DataFrame:
    """Adds symbol, ts, open, high, low, close, volume to messages with a closed kline; all other rows go.

    Rows go if the JSON cannot be read, the kline is not closed, or a number is missing or none. Works on streams too.
    """
    k = F.from_json(text, KLINE)["data"]["k"]
    parsed = messages.withColumn("_k", k).where(F.col("_k.x"))
    numbers = {name: F.col(f"_k.{field}").try_cast("double") for name, field in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"), ("volume", "v"))}
    return (
        parsed.withColumns({"symbol": store_key(F.col("_k.s"), F.col("_k.i")), "ts": F.col("_k.t"), **numbers})
        .drop("_k")
        .dropna(subset=["symbol", "ts", *numbers])
    )
