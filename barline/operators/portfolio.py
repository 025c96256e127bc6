"""Average-cost accounting of fills: a signed position per symbol, realized gains on what is reduced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.ordered import folded
from barline.functions.scalars import DUST, signed_qty, unrealized_pnl

POSITIONS = "symbol string, position double, avg_cost double, realized_pnl double, cash double, trades long"


class Account:
    """One symbol's position. Buying and selling mirror each other, so a fill is a signed quantity at a price."""

    def __init__(self) -> None:
        self.position = self.cost = self.realized = self.cash = 0.0
        self.trades = 0

    def apply(self, sign: float, qty: float, price: float) -> None:
        held = abs(self.position)
        if self.position * sign >= 0:  # opens or adds: the cost is blended
            self.cost = (held * self.cost + qty * price) / (held + qty)
            self.position += sign * qty
        else:
            closed = min(qty, held)
            self.realized += sign * (self.cost - price) * closed
            self.position += sign * closed
            rest = qty - closed
            if rest > qty * DUST:  # turns around, at the price of the fill
                self.position, self.cost = sign * rest, price
        if abs(self.position) <= qty * DUST:  # flat, so no old cost gets into the next position
            self.position = self.cost = 0.0
        self.cash -= sign * qty * price
        self.trades += 1


def positions(fills: DataFrame, order: list[str]) -> DataFrame:
    """symbol, position, avg_cost, realized_pnl, cash, trades after all fills (symbol, side, price, qty), in `order`.

    cash is the change of cash by this symbol; cash and realized_pnl of an account are sums over its symbols. A symbol's
    fills pass through one task, since each cost depends on the one before, but are never held together.
    """

    def step(account: Account, fill: dict) -> list[tuple]:
        account.apply(1.0 if fill["side"] == "B" else -1.0, fill["qty"], fill["price"])
        return []

    def last(account: Account, key: tuple) -> list[tuple]:
        return [(*key, account.position, account.cost, account.realized, account.cash, account.trades)]

    lean = fills.select("symbol", *(c for c in order if c != "symbol"), "side", "price", "qty")
    return folded(lean, ["symbol"], order, Account, step, POSITIONS, last)


def total_pnl(held: DataFrame, marks: DataFrame, start_cash: float = 100_000.0) -> DataFrame:
    """One row: realized, unrealized over the symbols of marks (symbol, mark), total and cash of an account."""
    open_pnl = held.join(marks, "symbol").agg(F.coalesce(F.sum(unrealized_pnl(F.col("position"), F.col("avg_cost"), F.col("mark"))), F.lit(0.0)).alias("unrealized"))
    booked = held.agg(F.coalesce(F.sum("realized_pnl"), F.lit(0.0)).alias("realized"), (F.coalesce(F.sum("cash"), F.lit(0.0)) + start_cash).alias("cash"))
    both = open_pnl.select("unrealized", F.lit(0.0).alias("realized"), F.lit(0.0).alias("cash")).unionByName(booked.select(F.lit(0.0).alias("unrealized"), "realized", "cash"))
    return both.agg(F.sum("realized").alias("realized"), F.sum("unrealized").alias("unrealized"), F.sum("cash").alias("cash")).withColumn("total", F.col("realized") + F.col("unrealized"))


def cash_flows(fills: DataFrame) -> DataFrame:
    """symbol, trades, bought, sold, cash: the part of the accounts that is a plain sum, without a fold."""
    value = F.col("qty") * F.col("price")
    return fills.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("trades"),
        F.sum(F.when(F.col("side") == "B", F.col("qty")).otherwise(0.0)).alias("bought"),
        F.sum(F.when(F.col("side") == "S", F.col("qty")).otherwise(0.0)).alias("sold"),
        F.sum(-signed_qty(F.col("side"), value)).alias("cash"),
    )
