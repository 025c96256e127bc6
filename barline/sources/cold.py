"""Cold storage of candles: Parquet by symbol, files checked by their footers before they are read.

Folders are symbol=<escaped by Spark>, which unlike a plain replacement of signs is reversible. Very many symbols are
kept in files of ranges instead, with the symbol as a column, as a folder for each would take longer to write and list
than the candles; a path has one of both layouts, and Spark refuses to read a mix. A file is accepted if
it has no brand and no version, or this brand with a version up to the current one, and if the columns are there with
their types; more columns are ignored. Spark itself would read a missing column as null, so the footers are checked.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions.schema import BAR
from barline.sources.shared import saved, shared_path  # noqa: F401

BRAND, VERSION = "barline", 1
KINDS = {"ts": "int64"} | {f: "double" for f in BAR.names[1:]}


def write(candles: DataFrame, path: str, folders: bool = True) -> None:
    """Append candles (symbol, ts, open .. volume; `spill`, the number of the write, if there) below `path`.

    File names are new in each write, so nothing is overwritten. Rows are sorted by ts in each file, so that a range of
    ts needs few row groups. With folders=False the number of files does not depend on that of the symbols: each has a
    range of (symbol, ts), and Parquet's own statistics tell which row groups have a symbol.
    """
    columns = ["symbol", *BAR.names, *(["spill"] if "spill" in candles.columns else [])]
    # A hot symbol is spread over tasks by a part of its range of ts.
    cut = candles.select(*columns).repartitionByRange("symbol", "ts").sortWithinPartitions("symbol", "ts")
    if not folders:
        cut = cut.withColumn("layout", F.lit("ranges"))
    cut.write.mode("append").partitionBy("symbol" if folders else "layout").parquet(path)


def fault_of(metadata: dict[bytes, bytes] | None, schema: pa.Schema) -> str | None:
    """Why a file is refused, null if it is not."""
    held = metadata or {}
    brand, version = held.get(b"brand"), held.get(b"schema_version")
    if brand is not None or version is not None:
        if brand != BRAND.encode() or version is None or not version.isdigit():
            return "UnknownSchema"
        if int(version) > VERSION:
            return "NewerVersion"
    for name, kind in KINDS.items():
        if name not in schema.names:
            return f"MissingColumn {name}"
        if str(schema.field(name).type) != kind:
            return f"WrongColumnType {name}"
    return None


def check_files(spark: SparkSession, path: str, glob: str = "*.parquet") -> DataFrame:
    """path, fault for each Parquet file below `path`: footers are read on the executors; unreadable files have a fault too.

    The listing is Spark's, so any store will do. Whole files are sent to their task one at a time, of which a file of
    candles must be small enough to fit; large tables are checked when they are written.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            faults = []
            for content in batch.column("content"):
                try:
                    schema = pq.read_schema(pa.BufferReader(content.as_buffer()))
                    faults.append(fault_of(schema.metadata, schema))
                except (pa.ArrowException, OSError) as e:
                    faults.append(f"Unreadable {type(e).__name__}")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(faults, pa.string())], ["path", "fault"])

    return files.select("path", "content").mapInArrow(footers, "path string, fault string")


def read(spark: SparkSession, path: str, *, checked: bool = False) -> DataFrame:
    """Candles below `path`, with `symbol` from the folder, or from the files of ranges, and `spill` if it was written.

    With checked=True only files that pass check_files are read, for folders that others write to. A filter on symbol
    prunes folders, or row groups of ranges, and one on ts is pushed down to row groups.
    """
    schema = f"{BAR.simpleString()[7:-1].replace(':', ' ')}, spill long, symbol string"
    if not checked:
        return spark.read.schema(schema).parquet(path).drop("layout")
    good = [r["path"] for r in check_files(spark, path).where("fault IS NULL").select("path").toLocalIterator()]
    if not good:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*good).drop("layout")


def deduplicated(cold: DataFrame) -> DataFrame:
    """One row for each symbol and ts; of several the one of the newest spill, then of the greatest values."""
    columns = [c for c in cold.columns if c not in ("symbol", "ts")]
    value = F.struct(*(F.col(c) for c in ("spill", *(c for c in columns if c != "spill")) if c in columns))
    best = cold.groupBy("symbol", "ts").agg(F.max(value).alias("_best"))
    return best.select(*(c if c in ("symbol", "ts") else F.col(f"_best.{c}").alias(c) for c in cold.columns))


def query(cold: DataFrame, symbol: str, start: int, end: int) -> DataFrame:
    """Candles of a symbol with start <= ts <= end, one for each ts, by ts."""
    wanted = cold.where((F.col("symbol") == symbol) & F.col("ts").between(start, end))
    return deduplicated(wanted).orderBy("ts")
