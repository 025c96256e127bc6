"""Order-sensitive functions that do not put all rows of a key into one task.

A plain window over (key ORDER BY seq) sorts each key in one task, and a key may hold a third of all rows. Here the
order is cut into ranges of about equally many rows, however skewed or often equal its values are. Running values are
summed up by range, carried over the ranges, which are few, and finished inside each range. Frames of bounded length get
blocks of consecutive rows with the rows before them as a margin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from barline.sources.shared import saved

#: Rows per range or block, roughly, and how many ranges there are at most; beyond that they have more rows.
ROWS, RANGES = 1 << 17, 1 << 15


class Spread(NamedTuple):
    """How many rows the largest key has, and all keys together. Larger values do no harm."""

    rows: int
    total: int

    def with_more(self, other: Spread) -> Spread:
        return Spread(self.rows + other.rows, self.total + other.total)


def spread(df: DataFrame, keys: list[str]) -> Spread:
    """One pass over df; hand the result on where a table is derived from df without more rows."""
    n, total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    return Spread(n or 0, total or 0)


def with_range(df: DataFrame, by: list[str], known: Spread, rows: int = ROWS) -> DataFrame:
    """Adds `_range`: numbers that ascend with the columns `by`, keys first, each for about `rows` rows; 0 for all if no key has more.

    Spark samples the columns and cuts them into ranges of equally many rows; equal values of the first columns are cut
    by those after them. The result is written, so that all that is derived from it sees the same ranges.
    """
    if known.rows <= rows:
        return df.withColumn("_range", F.lit(0).cast("long"))
    ranges = min(RANGES, -(-known.total // rows))
    return saved(df.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id().cast("long")), "ranges")


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], rows: int = ROWS, known: Spread | None = None) -> DataFrame:
    """Adds for each name a sum ("sum") or maximum ("max") over all earlier rows of the same keys, without the row itself.

    order must be unique within keys. Sums of nothing are 0, maxima null. Without `known` df is read once more, for its
    spread.
    """
    functions: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max}
    cut = with_range(df, [*keys, *order], known or spread(df, keys), rows).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_range").agg(*(functions[how](f"_v_{n}").alias(f"_t_{n}") for n, (how, _) in values.items()))
    carried = totals.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_range").alias("_k_range"), *(functions[how](f"_t_{n}").over(before).alias(f"_c_{n}") for n, (how, _) in values.items()))
    within = cut.withColumns({f"_i_{n}": functions[how](f"_v_{n}").over(inside) for n, (how, _) in values.items()})
    on = F.col("_range") == F.col("_k_range")
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = within.join(carried, on)

    def whole(n: str, how: str) -> Column:
        parts = [F.col(f"_c_{n}"), F.col(f"_i_{n}")]
        return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0))) if how == "sum" else F.greatest(*parts)

    return joined.select(*df.columns, *(whole(n, how).alias(n) for n, (how, _) in values.items()))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n", rows: int = ROWS, known: Spread | None = None) -> DataFrame:
    """Adds the row number, from 1, within keys in the given order."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("long"))}, rows, known).withColumn(name, F.col(name) + 1)


def framed(df: DataFrame, keys: list[str], number: str, lookback: int, made: Callable[[Window], dict[str, Column]], rows: int = ROWS) -> DataFrame:
    """Adds the columns that `made` builds on a window of the keys, ordered by `number`, that looks back `lookback` rows at most."""
    rows = max(rows, lookback)
    block = F.floor((F.col(number) - 1) / rows).cast("long")
    own = F.struct(block.alias("at"), F.lit(False).alias("margin"))
    ahead = F.struct((block + 1).alias("at"), F.lit(True).alias("margin"))
    tail = (F.col(number) - 1) % rows >= rows - lookback
    placed = df.withColumn("_place", F.explode(F.when(tail, F.array(own, ahead)).otherwise(F.array(own))))
    window = Window.partitionBy(*keys, "_place.at").orderBy(number)
    return placed.withColumns(made(window)).where("NOT _place.margin").drop("_place")


def folded(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str, last: Callable[[object, tuple], list[tuple]] | None = None) -> DataFrame:
    """Rows that a sequential rule gives: step(state, row) for each row of a key in order, last(state, key) at its end.

    For rules whose state depends on all rows before. Only the state is held in memory, never the rows of a key; a key's
    rows pass through one task, as each needs the result of the row before.
    """
    columns = df.columns
    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = None, None
        for batch in batches:
            out: list[tuple] = []
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(columns, values, strict=True))
                own = tuple(row[k] for k in keys)
                if state is None or own != key:
                    if state is not None and last:
                        out += last(state, key)
                    state, key = start(), own
                out += step(state, row)
            yield _batch(out, arrow)
        if state is not None and last:
            yield _batch(last(state, key), arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
