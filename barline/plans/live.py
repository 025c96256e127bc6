"""Queries that run the streaming twins over the events table, against the SQL of their batch forms."""

from __future__ import annotations

from barline.operators import risk
from barline.plans import market as batch
from barline.sources import cold, market
from barline.streaming import live


def stream_bars(spark, sf_dir):
    """The bars that were closed by the last event; the open ones are still state."""
    return live.drain(live.bars(live.events(spark, sf_dir)), "stream-bars")


def stream_ingest(spark, sf_dir):
    path = cold.shared_path(spark, "stream-ingest")
    live.store_candles(batch.damaged(market.ticks(live.events(spark, sf_dir))), path)
    return spark.read.parquet(f"{path}/candles").drop("batch")


def stream_last_n(spark, sf_dir):
    """The five newest ticks of each symbol, held as keyed state."""
    return live.latest_rings(live.drain(live.rings(market.ticks(live.events(spark, sf_dir)), 5), "stream-rings"))


def stream_crossover(spark, sf_dir):
    """Crossings of ticks by arrival. Every tick counts, as in the SQL; ticks may share a ts or come late."""
    return live.drain(live.crossovers(market.ticks(live.events(spark, sf_dir)), every=True), "stream-crossover")


def stream_executor(spark, sf_dir):
    verdicts = live.drain(live.executions(market.signals(live.events(spark, sf_dir)), batch.GATES), "stream-executor")
    return risk.executor_position(verdicts)


CLOSED_SQL = f"SELECT * FROM ({batch.BARS}) WHERE (seq + 1) * 3600000000 <= (SELECT epoch_ms(max(ts)) * 1000 FROM events) - 3600000000"
ORACLES = {
    "stream_bars": CLOSED_SQL,
    "stream_ingest": batch.ORACLES["valid_candles"],
    "stream_last_n": f"SELECT symbol, seq, ts, open, high, low, close, volume FROM ({batch.TICKS}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) <= 5",
    "stream_crossover": batch.CROSS_SQL.replace(batch.BARS, batch.TICKS),
    "stream_executor": batch.EXECUTOR_SQL,
}
QUERIES = {name: globals()[name] for name in ORACLES}
