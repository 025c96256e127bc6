"""The candle store as views of its append log: which rows a bounded, least-recently-appended store would still hold.

A symbol is hot from its first append until `max_symbols` other symbols were appended after it; each such stay is a
residency. Of a residency the last `ring_capacity` rows exist; those of past residencies are cold. All of it follows
from the order of appends (symbol, seq), so the store needs no state of its own.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barline.functions.options import StoreOptions
from barline.functions.ordered import ROWS, running, spread, with_range
from barline.functions.scalars import CANDLE_BYTES
from barline.functions.schema import first_fault, is_valid
from barline.sources import cold as cold_storage
from barline.sources.cold import deduplicated, saved

RING_CAPACITY = 10_000


def ingest(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows of a log of candles, and the others with `fault`, the first column at fault. For streams too."""
    return log.where(is_valid()), log.where(~is_valid()).withColumn("fault", first_fault())


def replay(appends: DataFrame, max_symbols: int, rows: int = ROWS) -> DataFrame:
    """The appends (symbol, seq and any others) with inserted, victim: whether the symbol came (back) in, and who had to go for it.

    The log is cut into ranges of seq. What the store holds after a range is its max_symbols latest symbols; these
    summaries are combined over all earlier ranges in a logarithmic number of steps, and each range is then gone through
    by itself from the state before it. A task holds max_symbols symbols at a time, whatever the log.
    """
    room, names = max(1, max_symbols), appends.columns
    known = spread(appends, [])
    cut = with_range(appends, ["seq"], known, rows)
    placed = cut.withColumn("_held", F.lit(False))
    if known.rows > rows:
        newest = Window.partitionBy("_range").orderBy(F.col("seq").desc())
        latest = lambda df: df.groupBy("_range", "symbol").agg(F.max("seq").alias("seq")).withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= room).drop("_rank")
        state = saved(latest(cut), "latest")
        ranges = state.agg(F.max("_range")).first()[0] + 1
        step = 1
        while step < ranges:
            moved = state.withColumn("_range", F.col("_range") + step).where(F.col("_range") < ranges)
            state = saved(latest(state.unionByName(moved)), "latest")
            step *= 2
        before = state.select("symbol", "seq", (F.col("_range") + 1).alias("_range"), F.lit(True).alias("_held"))
        # Ranges without an append of their own have no summary of their own, but their state is never asked for.
        placed = placed.unionByName(before.join(cut.select("_range").distinct(), "_range", "left_semi"), allowMissingColumns=True)
    sorted_in = placed.repartition("_range").sortWithinPartitions("_range", F.col("_held").desc(), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, OrderedDict()
        for batch in batches:
            inserted: list[bool] = []
            victims: list[str | None] = []
            for symbol, place in zip(batch.column("symbol").to_pylist(), batch.column("_range").to_pylist(), strict=True):
                if place != now:
                    now, held = place, OrderedDict()
                new, victim = symbol not in held, None
                if new and len(held) >= room:
                    victim = held.popitem(last=False)[0]
                held[symbol] = None
                held.move_to_end(symbol)
                inserted.append(new)
                victims.append(victim)
            kept = batch.select(names)
            told = pa.RecordBatch.from_arrays([*kept.columns, pa.array(inserted, pa.bool_()), pa.array(victims, pa.string())], [*names, "inserted", "victim"])
            yield told.filter(pc.invert(batch.column("_held")))

    return sorted_in.mapInArrow(run, StructType([*appends.schema.fields, *StructType.fromDDL("inserted boolean, victim string").fields]))


def residency(appends: DataFrame, max_symbols: int) -> DataFrame:
    """The appends (with all their columns) and `residency`, numbered from 1 for each symbol. It is written, as it is read several times."""
    flags = saved(replay(appends, max_symbols).drop("victim").withColumn("inserted", F.col("inserted").cast("long")), "replayed")
    counted = running(flags, ["symbol"], ["seq"], {"_before": ("sum", F.col("inserted"))})
    return saved(counted.select(*appends.columns, (F.col("_before") + F.col("inserted")).alias("residency")), "residency")


def lru_victims(appends: DataFrame, max_symbols: int) -> DataFrame:
    """seq, symbol, victim for each append that pushed another symbol out."""
    return replay(appends, max_symbols).where("victim IS NOT NULL").select("seq", "symbol", "victim")


def live_rows(placed: DataFrame, ring_capacity: int = RING_CAPACITY) -> DataFrame:
    """Of each residency the rows that its ring did not overwrite."""
    newest = Window.partitionBy("symbol", "residency").orderBy(F.col("seq").desc())
    return placed.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= max(1, ring_capacity)).drop("_age")


def hot_symbols(placed: DataFrame, max_symbols: int) -> DataFrame:
    """symbol, residency of what the store holds at the end: the latest max_symbols symbols."""
    last = placed.groupBy("symbol").agg(F.max("residency").alias("residency"), F.max("seq").alias("last_seq"))
    return last.orderBy(F.col("last_seq").desc()).limit(max(1, max_symbols)).select("symbol", "residency")


def hot_scan(placed: DataFrame, max_symbols: int, ring_capacity: int = RING_CAPACITY) -> DataFrame:
    """All rows in memory at the end."""
    return live_rows(placed.join(hot_symbols(placed, max_symbols), ["symbol", "residency"], "left_semi"), ring_capacity)


def cold_rows(placed: DataFrame, max_symbols: int, ring_capacity: int = RING_CAPACITY) -> DataFrame:
    """All rows that were spilled; `spill` is the residency that they are from."""
    past = placed.join(hot_symbols(placed, max_symbols), ["symbol", "residency"], "left_anti")
    return live_rows(past, ring_capacity).withColumn("spill", F.col("residency"))


def opened(log: DataFrame, options: StoreOptions = StoreOptions()) -> tuple[DataFrame, DataFrame | None]:
    """The store that a log of candles makes: its rows in memory, and its cold rows as read from options.data_dir.

    Invalid candles are left out. Without a data_dir past residencies are dropped, and there are no cold rows.
    """
    placed = residency(ingest(log)[0], options.max_symbols)
    hot = hot_scan(placed, options.max_symbols, options.ring_capacity)
    if options.data_dir is None:
        return hot, None
    cold_storage.write(cold_rows(placed, options.max_symbols, options.ring_capacity).select(*log.columns, "spill"), options.data_dir)
    return hot, cold_storage.read(log.sparkSession, options.data_dir)


def time_range(candles: DataFrame, symbol: str, start: int, end: int) -> DataFrame:
    """Candles of a symbol with start <= ts <= end. An unknown symbol and start > end give no rows; equal ts are kept."""
    return candles.where((F.col("symbol") == symbol) & F.col("ts").between(start, end))


def bounded_range(candles: DataFrame, symbol: str, start: int, end: int, most: int) -> DataFrame:
    """The oldest `most` of a range."""
    if most < 0:
        raise ValueError("a range cannot have fewer than 0 rows")
    return time_range(candles, symbol, start, end).orderBy("ts", "seq").limit(most)


def last_n(hot: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each symbol by arrival, not by ts. Only hot rows count."""
    newest = Window.partitionBy("symbol").orderBy(F.col("seq").desc())
    return hot.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def merged(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Hot and cold rows together: of equal symbol and ts only the hot ones, all of them; cold ones once."""
    columns = [c for c in hot.columns if c in cold.columns]
    once = deduplicated(cold).select(columns)
    return once.join(hot.select("symbol", "ts").distinct(), ["symbol", "ts"], "left_anti").unionByName(hot.select(columns))


def hot_statistics(hot: DataFrame) -> DataFrame:
    """symbol, candles, oldest_ts (of the oldest row by arrival), newest_ts for the symbols in memory."""
    return hot.groupBy("symbol").agg(F.count(F.lit(1)).alias("candles"), F.min_by("ts", "seq").alias("oldest_ts"), F.max_by("ts", "seq").alias("newest_ts"))


def late_rows(placed: DataFrame) -> DataFrame:
    """Rows whose ts is below that of the row before in the same residency."""
    # The row before, over ranges: the greatest (seq, ts) so far.
    before = running(placed, ["symbol", "residency"], ["seq"], {"_last": ("max", F.struct("seq", "ts"))})
    return before.where(F.col("ts") < F.col("_last.ts")).drop("_last")


def snapshot(log: DataFrame, max_symbols: int, ring_capacity: int = RING_CAPACITY) -> DataFrame:
    """One row of counters over the whole life of the store: appends, invalid, out_of_order, evictions, spill_bytes, symbols.

    spill_bytes counts rows at their size in memory. Rows that are dropped for want of cold storage count as well.
    """
    valid, invalid = ingest(log)
    placed = residency(valid, max_symbols)
    size = placed.groupBy("symbol", "residency").agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_seq"))
    size = saved(size, "residencies")
    spilled = size.join(hot_symbols(size.withColumnRenamed("last_seq", "seq"), max_symbols).withColumn("hot", F.lit(1)), ["symbol", "residency"], "left")
    rows = F.sum(F.when(F.col("hot").isNull(), F.least(F.col("rows"), F.lit(max(1, ring_capacity)))))
    totals = spilled.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("appends"),
        F.count_if(F.col("hot").isNull()).alias("evictions"),
        (F.coalesce(rows, F.lit(0)) * CANDLE_BYTES).alias("spill_bytes"),
        F.count("hot").alias("symbols"),
    )
    n = F.count(F.lit(1))
    # One row each.
    return totals.crossJoin(invalid.agg(n.alias("invalid"))).crossJoin(late_rows(placed).agg(n.alias("out_of_order"))).select("appends", "invalid", "out_of_order", "evictions", "spill_bytes", "symbols")
