"""Intermediate tables in the folder that all executors share, and runs of equal keys inside Arrow tasks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on one machine, an error on a cluster."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file:///tmp/checkpoints/barline"
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def saved(df: DataFrame, label: str) -> DataFrame:
    """The rows of df, written once to the shared folder: the plan is cut there and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what `saved` wrote in this process. Call it once no result built on it is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, or with underscores after it as long as df has such a column."""
    while name in df.columns:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, for input that is sorted by the keys within its partition."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(k) for k in keys]
        starts = [0]
        codes = None
        for column in columns:
            a, b = column.slice(0, batch.num_rows - 1), column.slice(1)
            changed = pc.not_equal(a, b)
            codes = changed if codes is None else pc.or_(codes, changed)
        if batch.num_rows > 1:
            starts += [i + 1 for i in pc.indices_nonzero(codes).to_pylist()]
        for at, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[at].as_py() for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(at, end - at))
            last = key
    if held:
        yield pa.concat_tables(held)


#: Bits of an id filter at most, 16 MB; with more ids than an eighth of that it lets ever more others through.
FILTER_BITS = 1 << 27


def likely_in(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose `column` is in the one column of `ids`, and a few others: a Bloom filter ahead of a join.

    The filter has a fixed size bound and goes to all executors, so that the rows that find no partner stay where they
    are. It only saves moving them; the join that follows decides.
    """
    n = ids.count()
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
    at = lambda c: [F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]
    places = ids.select(F.explode(F.array(*at(F.col(ids.columns[0])))).alias("bit"))
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("mask"))
    got = words.toArrow()  # at most bits / 64 rows
    mask = np.zeros(bits >> 6, np.uint64)
    mask[got.column("word").to_numpy()] = got.column("mask").to_numpy().view(np.uint64)
    sent, names = rows.sparkSession.sparkContext.broadcast(mask), rows.columns

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for place in (batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)):
                bit = place.fill_null(0).to_numpy(zero_copy_only=False)
                ok &= (sent.value[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            yield batch.select(names).filter(pa.array(ok))

    one, two = at(F.col(column))
    return rows.withColumns({"_bit_1": one, "_bit_2": two}).mapInArrow(step, rows.schema)
