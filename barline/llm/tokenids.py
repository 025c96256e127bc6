"""Token ids of all documents in one binary order, coded in blocks, and read back.

Documents are dealt by ranges of doc_id and sorted inside each range, so the parts follow each other in ascending
order without a global sort. A part is a run of blocks; a block holds whole documents and is coded on its own
(rangecoder), so any block can be read, checked or rewritten alone. The file format is a Parquet folder with one row
per block: part, block, doc_ids (i64 each; the first `nameless` of them stand for null), lengths (u32 each), payload. Spark writes and commits it, so a lost
executor leaves no half-written part and any store that Spark can write to will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm import rangecoder, shingles
from barline.llm.tables import new_path, partitions
from barline.llm.tokens import REMEMBERED, ByteLevelIds

#: A block is closed when it has so many ids.
BLOCK_IDS = 1 << 22
END = 0
FORMAT = "part int, block int, nameless int, doc_ids binary, lengths binary, n_ids long, payload binary"


def _blocks(vocabulary: str, remembered: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ByteLevelIds.of_file(vocabulary, remembered)
        part, block, end = TaskContext.get().partitionId(), 0, np.array([END], "<u2").tobytes()
        docs: list[np.ndarray] = []
        coded: list[bytes] = []
        held = nameless = 0

        def closed() -> pa.RecordBatch:
            lengths = np.array([len(c) // 2 for c in coded], "<u4")
            flat = np.frombuffer(b"".join(coded), "<u2")
            row = [part, block, nameless, np.concatenate(docs).astype("<i8").tobytes(), lengths.tobytes(), len(flat), rangecoder.encode(flat)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
            names = [x.split()[0] for x in FORMAT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in shingles.pieces(batches):
            nameless += batch.column("doc_id").null_count
            docs.append(batch.column("doc_id").fill_null(0).to_numpy())
            new = [x + end for x in ids.encode([t or "" for t in batch.column("text").to_pylist()])]
            coded += new
            held += sum(map(len, new)) // 2
            if held >= BLOCK_IDS:
                yield closed()
                docs, coded, held, nameless, block = [], [], 0, 0, block + 1
        if coded:
            yield closed()

    return step


def write_ids(docs: DataFrame, path: str, vocabulary: str, remembered: int = REMEMBERED) -> None:
    """Encode the texts of docs (doc_id, text; others are ignored) and write the blocks to `path`.

    Null texts have only the end id. Rows without a doc_id come first; rows that share one follow each other by a hash
    of the text, which also spreads them over ranges. Texts are encoded whole, at any length; a block is never cut inside a
    document. An empty table writes no block. `remembered` words are held in each table of a worker (tokens.py).
    """
    given = docs.select("doc_id", "text").withColumn("place", F.xxhash64("text"))
    placed = given.repartitionByRange(partitions(docs.sparkSession), "doc_id", "place").sortWithinPartitions("doc_id", "place", "text")
    placed.mapInArrow(_blocks(vocabulary, remembered), FORMAT).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = rangecoder.decode(row["payload"])
            lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
            if lengths.sum() != len(ids):
                raise ValueError("the lengths of a block do not add up")
            doc_ids = np.frombuffer(row["doc_ids"], "<i8")
            ends = np.cumsum(lengths)
            n = len(lengths)
            wide = ids.astype("<u4")
            crc = [zlib.crc32(wide[b - k : b]) for b, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row["part"], np.int32)),
                    pa.array(np.full(n, row["block"], np.int32)),
                    pa.array(doc_ids, mask=np.arange(n) < row["nameless"]),
                    pa.array(ends - lengths),
                    pa.array(lengths),
                    pa.array(crc, pa.int64()),
                ],
                ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"],
            )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the blocks at `path`, from decoded ids."""
    blocks = spark.read.schema(FORMAT).parquet(path)
    # One row per block: few, as a block has millions of ids; summed by part first, so that no window holds all blocks.
    before = F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    heads = blocks.select("part", "block", "n_ids").withColumn("in_part", F.coalesce(before, F.lit(0)))
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    so_far = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(so_far, F.lit(0)).alias("in_parts"))
    starts = heads.join(parts, "part").select("part", "block", (F.col("in_part") + F.col("in_parts")).alias("from"))
    kinds = "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long"
    decoded = blocks.select("part", "block", "nameless", "doc_ids", "lengths", "payload").mapInArrow(_documents, kinds)
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("from") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_and_read(docs: DataFrame, vocabulary: str, remembered: int = REMEMBERED) -> DataFrame:
    """Write the ids of docs to a new path in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary, remembered)
    return read_ids(docs.sparkSession, path)
