"""Mixing sources to target weights by a low-discrepancy schedule of blocks.

The mix is a row of slots. Slot i has the point i * (golden ratio) modulo 1; the point's place in the cumulative shares
names the source, so every stretch of the mix is close to the targets. Shares follow the targets, but no source has so
little that it lacks slots. The slots of a source are ranked; a source has a block length of its own, its target dealt
over its slots, and rank r takes block r of its documents, which are shuffled by a hash and laid end to end as often as
needed. The last block ends where the target does. Texts are not moved: all is worked out from ids and sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barline.llm.tables import free_name, saved

#: Slots of the mix, fewer if there are fewer words, more if there are so many sources; a block has at least one word.
SLOTS = 1 << 18
#: Slots that a source's share is raised to before all are scaled to one.
LEAST_SLOTS = 64
WEIGHTS = (5, 2, 1)
#: How often a source may be repeated.
REPEATS = 3
#: Sources up to which a few numbers of each are sent to all executors, some 4 MB; with more, Spark's skew join spreads a hot one.
BROADCAST = 1 << 16
GOLDEN = 2654435769  # 2 ** 32 / golden ratio, odd
_CHUNK, _CELL = 12, 20


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, slots: int) -> DataFrame:
    """k, source, source_size, target, low, high for the sources of sizes (source, size): a row per source.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Targets share the sum of all sizes by weight but stop
    at REPEATS times the source's size, the rest being shared by weight again: target = least(cap, level * weight),
    with the level at which the targets add up. low and high bound the source's part of the points below 2 ** 32, which
    is in proportion to its target, raised to that of LEAST_SLOTS of the slots.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = sources.withColumn("k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), F.col("k") % len(WEIGHTS))
    named = named.withColumn("weight", weight).withColumn("cap", REPEATS * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum(
        "weight"
    ).over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = named.withColumn("level", level)
    # The first source in this order that the level does not bring to its cap sets the level.
    chosen = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    filled = leveled.withColumn("target", F.least(F.col("cap").cast("double"), chosen * F.col("weight")))
    least = F.sum("target").over(everything) * (LEAST_SLOTS / slots)
    filled = filled.withColumn("part", F.when(F.col("target") > 0, F.greatest("target", least)).otherwise(0.0))
    upto = F.sum("part").over(Window.orderBy("k"))
    total = F.sum("part").over(everything)
    bound = lambda x: F.coalesce(F.floor(F.try_divide(x, total) * float(1 << 32)), F.lit(0)).cast("long")
    last = F.row_number().over(Window.orderBy(F.col("k").desc())) == 1
    high = F.when(last, F.lit(1 << 32)).otherwise(bound(upto))
    return filled.select("k", "source", "source_size", "target", high.alias("high")).withColumn(
        "low", F.coalesce(F.lag("high").over(Window.orderBy("k")), F.lit(0))
    )


def schedule(sources: DataFrame, slots: int) -> DataFrame:
    """slot, k, rank: the source of each slot and how many slots of that source come before it."""
    spark = sources.sparkSession
    point = F.pmod((F.col("id") + 1) * F.lit(GOLDEN), F.lit(1 << 32))
    points = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", _CELL))
    cells = F.sequence(F.shiftright("low", _CELL), F.shiftright(F.col("high") - 1, _CELL))
    parts = sources.where("low < high").select("k", "low", "high", F.explode(cells).alias("cell"))
    named = points.join(parts, "cell").where("low <= point AND point < high").select("slot", "k", F.shiftright("slot", _CHUNK).alias("chunk"))
    held = named.groupBy("k", "chunk").count()
    before = F.sum("count").over(Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select("k", "chunk", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1
    return named.withColumn("inside", inside).join(held, ["k", "chunk"]).select("slot", "k", (F.col("inside") + F.col("before")).alias("rank"))


def laid_out(sized: DataFrame, documents: int) -> DataFrame:
    """sized (row_id, doc_id, k, size) with `start`: the words of the source's documents before it in shuffled order.

    Prefix sums in two steps, over hash ranges of a source and inside one, so that a source of any size is spread.
    """
    ranges = max(64, 1 << (documents // 2048).bit_length())
    hashed = sized.withColumn("place", F.xxhash64("doc_id", F.lit(7))).withColumn("range", F.shiftright("place", 64 - (ranges - 1).bit_length()))
    sums = hashed.groupBy("k", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("k", "range", F.coalesce(before, F.lit(0)).alias("before"))
    order = Window.partitionBy("k", "range").orderBy("place", "doc_id", "size", "row_id")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hashed.withColumn("inside", inside).join(sums, ["k", "range"]).withColumn("start", F.col("inside") + F.col("before")).drop("inside", "before", "place", "range")


def mixed_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of docs, each as often as the mix takes its words, rounded; all columns are kept.

    A source's documents are taken in order up to its target, so at most one document of a source is taken in part and
    rounding keeps the targets.
    """
    row, times = free_name(docs, "_row"), free_name(docs, "_times")
    numbered = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(numbered.select(F.col(row).alias("doc_id"), "text", "source"), slots).where("taken > 0")
    often = taken.select(F.col("doc_id").alias(row), F.round(F.col("taken") / F.col("size")).cast("int").alias(times))
    copies = numbered.join(often.where(F.col(times) > 0), row)
    return copies.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(docs.columns)


def mix(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs (doc_id, text, source; others are ignored).

    size counts words, null and blank texts have none and are taken 0 times. A document gives the words that it has
    in the blocks of the schedule, REPEATS times at most; a source's add up to its target, rounded, in a corpus of any size. Repeated rows are documents of
    their own; a null source is a source, a null doc_id is ordered first. Words are counted in whole texts of any length.
    An empty table gives an empty result.
    """
    sized = saved(
        docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "source", size_of(F.col("text")).alias("size")), "sizes"
    )
    documents, words, names = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.countDistinct("source")).first()
    slots = max(min(words, slots), LEAST_SLOTS * (names + 1))
    sent = F.broadcast if names < BROADCAST else lambda numbers: numbers  # so that a hot source is not moved into one task
    sources = saved(targets(sized, slots), "targets")
    named = sized.join(sources.select("k", "source"), sized["source"].eqNullSafe(sources["source"])).select("row_id", "doc_id", "k", "size")
    laid = saved(laid_out(named, documents), "laid")
    ranked = saved(schedule(sources, slots).select("k", "rank"), "schedule")
    goal = F.round("target").cast("long").alias("goal")
    lengths = sources.join(ranked.groupBy("k").agg(F.count("*").alias("slots")), "k").select("k", "source_size", "slots", goal)
    lengths = lengths.withColumn("length", F.greatest(F.lit(1), F.ceil(F.col("goal") / F.col("slots"))).cast("long"))
    passes = laid.where("size > 0").join(sent(lengths), "k").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))))
    passes = passes.withColumn("first", F.col("start") + F.col("pass") * F.col("source_size")).where("first < goal")
    passes = passes.withColumn("end", F.least(F.col("first") + F.col("size"), "goal"))
    pieces = passes.withColumn("rank", F.explode(F.expr("sequence(first div length, (end - 1) div length)")))
    overlap = F.least("end", (F.col("rank") + 1) * F.col("length")) - F.greatest("first", F.col("rank") * F.col("length"))
    got = pieces.withColumn("words", overlap).join(ranked, ["k", "rank"]).groupBy("row_id").agg(F.sum("words").alias("taken"))
    return (
        laid.join(sent(sources.select("k", "source_size", "target")), "k")
        .join(got, "row_id", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )
