"""Risk gates and the executor: which signals are let through, and the position that they make."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.options import Gates
from barline.functions.ordered import folded

VERDICTS = ("Accepted", "InvalidQty", "PositionLimitExceeded", "RateLimitExceeded")


class Executor:
    """The state of one account: its position and its rate bucket."""

    def __init__(self, gates: Gates):
        self.gates, self.position, self.begun, self.used = gates, 0.0, None, 0

    def judge(self, side: str, qty: float | None, ts: int) -> str:
        gates = self.gates
        if qty is None or not math.isfinite(qty) or qty <= 0 or qty > gates.max_qty:
            return "InvalidQty"
        moved = self.position + (qty if side == "B" else -qty)
        if not math.isfinite(moved) or abs(moved) > gates.max_position:
            return "PositionLimitExceeded"
        if self.begun is None or ts - self.begun >= gates.bucket:
            self.begun, self.used = ts, 0
        if self.used >= gates.max_per_bucket:
            return "RateLimitExceeded"
        self.used += 1
        self.position = moved
        return "Accepted"


def risk_gate(signals: DataFrame, gates: Gates = Gates(), keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, seq, side, qty, verdict, position for each signal (seq, ts, side, qty) in order of seq; position is the one after it.

    An account is a value of `keys`; refused signals neither move its position nor use its rate. The gates depend on
    what was accepted before, so an account's signals pass through one task, one at a time.
    """
    lean = signals.select(*keys, "seq", "ts", "side", "qty")
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "seq long", "side string", "qty double", "verdict string", "position double"])

    def step(executor: Executor, row: dict) -> list[tuple]:
        verdict = executor.judge(row["side"], row["qty"], row["ts"])
        return [(*(row[k] for k in keys), row["seq"], row["side"], row["qty"], verdict, executor.position)]

    return folded(lean, list(keys), ["seq"], lambda: Executor(gates), step, schema)


def executor_position(judged: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """keys, position, and how many signals got each verdict."""
    counts = [F.count_if(F.col("verdict") == v).alias(n) for v, n in zip(VERDICTS, ("accepted", "bad_qty", "over_position", "over_rate"), strict=True)]
    return judged.groupBy(*keys).agg(F.max_by("position", "seq").alias("position"), *counts)
