"""Limit order books: replay of orders by price-time priority, and the parts that need no replay."""

from __future__ import annotations

import heapq
import math
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.ordered import folded, running
from barline.functions.scalars import DUST, MAX_PRICE, PRICE_SCALE, key_price, price_key

EVENTS = "symbol string, seq long, ord int, event string, order_id long, side string, price double, qty double, ts long, reason string"
LEFTOVER = {"IOC": "IocRemainder", "MARKET": "MarketNoLiquidity"}


@dataclass
class Resting:
    order_id: int
    side: str
    qty: float
    left: float

    @property
    def done(self) -> bool:
        return self.left <= self.qty * DUST


class Side:
    """Resting orders of one side: a heap of price levels, best first, each first in, first out."""

    def __init__(self, sign: int):
        self.sign, self.heap, self.levels = sign, [], {}

    def add(self, key: int, order: Resting) -> None:
        if key not in self.levels:
            self.levels[key] = deque()
            heapq.heappush(self.heap, self.sign * key)
        self.levels[key].append(order)

    def best(self) -> int | None:
        while self.heap and not self.levels[self.sign * self.heap[0]]:
            del self.levels[self.sign * heapq.heappop(self.heap)]
        return self.sign * self.heap[0] if self.heap else None

    def reaches(self, key: int, limit: int | None) -> bool:
        return limit is None or self.sign * key <= self.sign * limit

    def available(self, limit: int | None) -> float:
        return sum(o.left for k in sorted(self.levels, key=lambda k: self.sign * k) if self.reaches(k, limit) for o in self.levels[k])


def key_of(price: float) -> int:
    return math.floor(price * PRICE_SCALE + 0.5)


def is_good(qty: float | None, price: float | None) -> bool:
    if qty is None or not math.isfinite(qty) or qty <= 0:
        return False
    return price is None or (math.isfinite(price) and 0 < price <= MAX_PRICE)


class Book:
    """The book of one symbol. `submit` gives the events of an order: (event, order_id, side, price, qty, reason)."""

    def __init__(self) -> None:
        self.sides = {"B": Side(-1), "S": Side(1)}

    def submit(self, order_id: int, side: str, kind: str, price: float | None, qty: float) -> list[tuple]:
        refused = lambda reason: ("CANCEL", order_id, None, None, None, reason)
        if not is_good(qty, price) or (kind == "LIMIT" and price is None):
            return [refused("InvalidOrder")]
        limit = None if price is None else key_of(price)
        taker, others = Resting(order_id, side, qty, qty), self.sides["S" if side == "B" else "B"]
        if kind == "FOK" and others.available(limit) < qty * (1.0 - DUST):
            return [refused("FokNoFill")]
        events = []
        while not taker.done and (key := others.best()) is not None and others.reaches(key, limit):
            maker = others.levels[key][0]
            size = min(taker.left, maker.left)
            taker.left -= size
            maker.left -= size
            events += [("FILL", o.order_id, o.side, key / PRICE_SCALE, size, None) for o in (taker, maker)]
            if maker.done:
                others.levels[key].popleft()
        if not taker.done:
            if kind == "LIMIT":
                self.sides[side].add(limit, taker)
            elif kind in LEFTOVER:
                events.append(refused(LEFTOVER[kind]))
        return events


def replay(orders: DataFrame) -> DataFrame:
    """symbol, seq, ord, event, order_id, side, price, qty, ts, reason of all fills and cancels.

    orders (seq, symbol, side, kind, price, qty, ts; order_id if it is not seq) go into one book per symbol in order of
    seq. Fills come in pairs, the taker's first, at the maker's price. A book depends on every order before, so a
    symbol's orders pass through one task; it holds the resting orders only.
    """
    given = orders if "order_id" in orders.columns else orders.withColumn("order_id", F.col("seq"))
    lean = given.select("symbol", "seq", "order_id", "side", "kind", "price", "qty", "ts")

    def step(book: Book, o: dict) -> list[tuple]:
        events = book.submit(o["order_id"], o["side"], o["kind"], o["price"], o["qty"])
        return [(o["symbol"], o["seq"], n, event, i, side, price, qty, o["ts"] if event == "FILL" else None, why) for n, (event, i, side, price, qty, why) in enumerate(events)]

    return folded(lean, ["symbol"], ["seq"], Book, step, EVENTS)


def top(resting: DataFrame) -> DataFrame:
    """symbol, best_bid, best_ask, spread of resting orders (symbol, side, price); spread is null if a side is empty."""
    key = price_key(F.col("price"))
    best = resting.groupBy("symbol").agg(F.max(F.when(F.col("side") == "B", key)).alias("bid"), F.min(F.when(F.col("side") == "S", key)).alias("ask"))
    return best.select("symbol", key_price(F.col("bid")).alias("best_bid"), key_price(F.col("ask")).alias("best_ask"), key_price(F.col("ask") - F.col("bid")).alias("spread"))


def sweep(resting: DataFrame, takers: DataFrame) -> DataFrame:
    """symbol, seq, price, qty: what one taker per symbol (symbol, side, price or null, qty) takes from a fixed book.

    Makers (seq, symbol, side, price, qty) stand by price, then seq; each gives what is left of the taker's quantity
    after those before it, a difference of running sums.
    """
    wanted = takers.select("symbol", F.col("side").alias("_side"), price_key(F.col("price")).alias("_limit"), F.col("qty").alias("_want"))
    met = resting.join(wanted, "symbol").where(F.col("side") != F.col("_side")).withColumn("_key", price_key(F.col("price")))
    rank = F.when(F.col("_side") == "B", F.col("_key")).otherwise(-F.col("_key"))
    reach = F.when(F.col("_side") == "B", F.col("_limit")).otherwise(-F.col("_limit"))
    met = met.withColumn("_rank", rank).where(reach.isNull() | (F.col("_rank") <= reach))
    ahead = running(met, ["symbol"], ["_rank", "seq"], {"_ahead": ("sum", F.col("qty"))})
    taken = F.least(F.col("_want"), F.col("_ahead") + F.col("qty")) - F.least(F.col("_want"), F.col("_ahead"))
    return ahead.withColumn("_taken", taken).where("_taken > 0").select("symbol", "seq", key_price(F.col("_key")).alias("price"), F.col("_taken").alias("qty"))


def fok_feasibility(resting: DataFrame, orders: DataFrame) -> DataFrame:
    """symbol, seq, available, feasible: whether a fixed book could fill each order (seq, symbol, side, price or null, qty) whole.

    What stands at or better than a price is a running sum over the keys of the other side, looked up by merging orders
    and makers into one series, so that orders do not meet makers one by one.
    """
    aim = F.when(F.col("side") == "B", price_key(F.col("price"))).otherwise(-price_key(F.col("price")))
    stand = F.when(F.col("side") == "S", price_key(F.col("price"))).otherwise(-price_key(F.col("price")))
    other = F.when(F.col("side") == "B", "S").otherwise("B")
    makers = resting.select("symbol", "side", stand.alias("_rank"), F.lit(0).alias("_late"), "seq", F.col("qty").alias("_stands"), F.lit(None).cast("double").alias("qty"))
    # Without a price an order reaches as far as the last maker.
    ends = makers.groupBy("symbol", "side").agg(F.max("_rank").alias("_end"))
    asked = orders.select("symbol", other.alias("side"), aim.alias("_aim"), "seq", "qty").join(ends, ["symbol", "side"], "left")
    asked = asked.select("symbol", "side", F.coalesce("_aim", "_end", F.lit(0)).alias("_rank"), F.lit(1).alias("_late"), "seq", F.lit(0.0).alias("_stands"), "qty")
    summed = running(makers.unionByName(asked), ["symbol", "side"], ["_rank", "_late", "seq"], {"available": ("sum", F.col("_stands"))})
    return summed.where("_late = 1").select("symbol", "seq", "available", (F.col("available") >= F.col("qty") * (1.0 - DUST)).alias("feasible"))
