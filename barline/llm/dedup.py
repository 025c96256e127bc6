"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has SLOTS minima of BITS bits. It is split into SLOTS / CHUNK chunks; by the pigeonhole principle two
signatures that differ in fewer slots than twice the number of chunks agree in some chunk up to one slot, so the keys
(chunk, slot left out, the other slots) put every such pair into a common bucket. Pairs beyond that distance are still
met with a probability that falls slowly: at a similarity of 0.75 the chance of no common key is 4e-5.

No bucket is expanded into pairs. In a bucket only a spanning forest of the pairs within FAR slots is emitted; the
connected parts of all forests are candidate clusters. Inside a cluster all pairs are compared exactly on their full
shingle sets, block against block, and again only a spanning forest of the confirmed links is emitted. In clusters
over one block, members that are confirmed copies of the cluster's least member are not compared with one another.
Equal shingle sets are merged before any of this, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import shingles
from barline.llm.components import components
from barline.llm.tables import likely_in, partitions, runs, saved

SLOTS, BITS, CHUNK = 50, 16, 5
#: Slots that a pair with similarity 0.75 differs in at most, but for 4e-5 of such pairs.
FAR = 25
#: Larger buckets are tied to their least member without a look at the signatures.
BUCKET = 256
#: Documents of a cluster that are compared with as many others in one step.
BLOCK = 256

_SLOT = shingles._odd(5, SLOTS)
_KEY = shingles._odd(6, SLOTS // CHUNK * CHUNK)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(SLOTS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(low, (found[None, at : at + 4096] * _SLOT[:, None]).min(axis=1), out=low)
    return ((low >> np.uint64(24)) & np.uint64((1 << BITS) - 1)).astype("<u2")


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = shingles.WordHashes()
    for batch in shingles.pieces(batches):
        sets = [shingles.shingle_set(hashes.of(t)) for t in shingles.texts_of(batch)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([signature(s).tobytes() for s in sets], pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_id", "signature"],
        )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shingles.pieces(batches, 4096):
        chunks = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").astype(np.uint64)
        chunks = chunks.reshape(batch.num_rows, SLOTS // CHUNK, CHUNK)
        keys = np.empty(chunks.shape, np.uint64)
        for out in range(CHUNK):
            rest = np.zeros(chunks.shape[:2], np.uint64)
            for slot in range(CHUNK):
                if slot != out:
                    rest = (rest << np.uint64(BITS)) | chunks[:, :, slot]
            keys[:, :, out] = rest
        keys = shingles.mixed(keys.reshape(batch.num_rows, -1) ^ _KEY[None, :])
        rep = batch.column("rep").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep, keys.shape[1]))], ["key", "rep"]
        )


class Forest:
    """Disjoint sets of the integers below n; `tie` says whether two of them were apart until now."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def tie(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _near_in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input is sorted by key. A spanning forest of the pairs of a bucket within FAR slots."""
    for group in runs(batches, ["key"]):
        rep = group.column("rep").to_numpy()
        marks = np.frombuffer(b"".join(group.column("signature").to_pylist()), "<u2").reshape(len(rep), SLOTS)
        forest, a, b = Forest(len(rep)), [], []
        for i in range(1, len(rep)):
            for j in np.flatnonzero((marks[:i] != marks[i]).sum(axis=1) <= FAR).tolist():
                if forest.tie(i, j):
                    a.append(rep[i])
                    b.append(rep[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = shingles.WordHashes()
    for batch in shingles.pieces(batches):
        sets = [shingles.shingle_set(hashes.of(t)).tobytes() for t in shingles.texts_of(batch)]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, pa.field("found", pa.binary()), pa.array(sets, pa.binary()))


def _linked_in_blocks(share: int):
    """Input is sorted by cluster, i and j: the documents of block i, and of block j where that is another one.

    Each document is laid over one list of all shingles of the block, so that its intersections with all others
    are one pass. Two documents that were both linked to the cluster's least member (`sure`) are not compared.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["cluster", "i", "j"]):
            rep, part, sure = (group.column(c).to_numpy() for c in ("rep", "part", "sure"))
            found = [np.frombuffer(x, "<u8") for x in group.column("found").to_pylist()]
            size = np.array([len(x) for x in found])
            _, ids = np.unique(np.concatenate(found), return_inverse=True)
            ends = np.cumsum(size)
            starts, seen = ends - size, np.zeros(len(ids) + 1, np.int32)
            i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
            forest, a, b = Forest(len(rep)), [], []
            for x in range(1, len(rep)):
                own = ids[starts[x] : ends[x]]
                seen[own] = 1
                both = np.add.reduceat(seen[ids[: starts[x]]], starts[:x])
                seen[own] = 0
                close = 100 * both >= share * (size[:x] + size[x] - both)
                if i != j:
                    close &= part[:x] != part[x]
                close &= ~(sure[:x] & sure[x])
                for y in np.flatnonzero(close).tolist():
                    if forest.tie(x, y):
                        a.append(rep[x])
                        b.append(rep[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return step


def _linked_to_first(share: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.pieces(batches):
            sure = []
            for own, first in zip(batch.column("found").to_pylist(), batch.column("first").to_pylist(), strict=True):
                a, b = np.frombuffer(own, "<u8"), np.frombuffer(first, "<u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                sure.append(100 * both >= share * (len(a) + len(b) - both))
            at = batch.schema.get_field_index("first")
            yield batch.set_column(at, pa.field("sure", pa.bool_()), pa.array(sure, pa.bool_()))

    return step


def _confirmed(docs: DataFrame, clusters: DataFrame, share: int) -> DataFrame:
    """Links (a, b) between documents of a cluster whose full sets are similar enough, as spanning forests of blocks."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    members = clusters.join(sizes, "cluster").withColumn("whole", F.col("members") <= BLOCK).drop("members")
    texts = likely_in(docs.select(F.col("doc_id").alias("rep"), "text"), "rep", clusters.select("rep"))
    sets = members.join(texts, "rep").select("cluster", "rep", "whole", "text").distinct()
    sets = saved(sets.mapInArrow(_sets, "cluster long, rep long, whole boolean, found binary"), "sets")
    one = sets.where("whole").selectExpr("cluster", "rep", "found", "false AS sure", "0 AS part", "0 AS i", "0 AS j")
    many = sets.where("NOT whole")
    first = many.where("rep = cluster").select("cluster", F.col("found").alias("first"))
    told = "cluster long, rep long, whole boolean, found binary, sure boolean"
    many = saved(many.join(first, "cluster").mapInArrow(_linked_to_first(share), told), "told")
    star = many.where("sure AND rep <> cluster").select(F.col("rep").alias("a"), F.col("cluster").alias("b"))
    # Parts below `open` hold the members that are not sure. All pairs of parts are compared but those of sure ones.
    parts = many.groupBy("cluster").agg(
        *(F.ceil(F.count_if(F.col("sure") == s) / BLOCK).cast("int").alias(c) for s, c in ((False, "open"), (True, "shut")))
    )
    spread = F.xxhash64("rep")
    pairs = (
        many.join(parts.where("open > 0"), "cluster")
        .withColumn("part", F.when(F.col("sure"), F.col("open") + F.pmod(spread, F.col("shut"))).otherwise(F.pmod(spread, "open")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, IF(sure, open, open + shut) - 1)")))
        .selectExpr("cluster", "rep", "found", "sure", "part", "least(part, other) AS i", "greatest(part, other) AS j")
    )
    blocks = one.unionByName(pairs).repartition(partitions(docs.sparkSession), "cluster", "i", "j")
    linked = blocks.sortWithinPartitions("cluster", "i", "j").mapInArrow(_linked_in_blocks(share), "a long, b long")
    return linked.unionByName(star)


def near_duplicates(docs: DataFrame, share: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text; other columns are ignored).

    Documents are linked if their sets of distinct five-word shingles have at least `share` percent of their union in
    common. A document of one to four words has one shingle, its whole text; without words (null, empty or blank
    text) it has none, and is its own component. component_id is the least doc_id reached. Repeated rows give
    repeated results; rows with equal doc_id and different texts count as linked. A null doc_id is linked with
    nothing and gets a null component_id, kept. Sets are made of whole texts, in memory that grows with one text. An empty
    table gives an empty result.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    profile = saved(
        docs.mapInArrow(_profiles, "doc_id long, n_shingles long, set_id binary, signature binary"), "profiles"
    )
    distinct = saved(
        profile.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature")),
        "distinct",
    )
    keys = distinct.select("rep", "signature").mapInArrow(_keys, "key long, rep long")
    shared = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top"), F.count("*").alias("n"))
    # Written, so that the join has a plain exchange on both sides and a key that very many share can be split.
    shared = saved(shared.where("hub < top").select("key", "hub", "n"), "shared")
    met = saved(keys.join(shared, "key"), "met")
    near = (
        met.where(F.col("n") <= BUCKET)
        .select("key", "rep")
        .join(distinct.select("rep", "signature"), "rep")
        .repartition(partitions(spark), "key")
        .sortWithinPartitions("key")
        .mapInArrow(_near_in_buckets, "a long, b long")
    )
    large = met.where((F.col("n") > BUCKET) & (F.col("rep") > F.col("hub"))).select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = saved(components(near.unionByName(large)), "clusters")
    links = _confirmed(docs, clusters.select(F.col("component").alias("cluster"), F.col("node").alias("rep")), share)
    # The texts of a repeated doc_id belong together.
    real = profile.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "set_id")
    twice = real.groupBy("doc_id").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high")
    tied = real.join(twice.select("doc_id"), "doc_id").join(distinct.select("set_id", "rep"), "set_id")
    found = components(links.unionByName(tied.select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))))
    classes = (
        distinct.select("set_id", "rep")
        .join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("set_id", F.coalesce("component", "rep").alias("component_id"))
    )
    return (
        profile.select("doc_id", "n_shingles", "set_id")
        .join(classes, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
