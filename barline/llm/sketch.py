"""Threshold-scaled sketches of word shingles: every hash below a fixed fraction of the hash space is kept.

Whether a hash is kept depends on the hash alone, so sketches of very unequal documents remain comparable, the sketch
of a union is the union of sketches, and containment is estimated without bias. All in DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WIDTH = 5
#: One in so many shingle hashes is kept.
SCALE = 4
_BLANKS = "[\\x20\\x09-\\x0D]+"


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """Sorted distinct shingle hashes below the fraction 1 / scale, as longs. Fewer words than `width` are one shingle."""
    top = -(1 << 63) + (1 << 64) // scale - 1
    trimmed = F.regexp_replace(F.lower(text), f"^{_BLANKS}", "")
    bound = F.array(F.split(trimmed, _BLANKS))  # bound once by the lambda, else each shingle would split the text again

    def hashes(words: Column) -> Column:
        n = F.size(words) - F.when(F.element_at(words, -1) == "", 1).otherwise(0)  # white space at the end
        starts = F.slice(words, 1, F.greatest(n - (width - 1), F.least(n, F.lit(1))))
        each = F.transform(starts, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))))
        return F.array_sort(F.array_distinct(F.filter(each, lambda h: h <= F.lit(top))))

    return F.get(F.transform(bound, hashes), F.lit(0))


def containment(of: Column, within: Column) -> Column:
    """Estimated share of the shingles of the one document that the other has; null if the first sketch is empty."""
    return F.when(F.size(of) > 0, F.size(F.array_intersect(of, within)) / F.size(of))


def merged(one: Column, other: Column) -> Column:
    """The sketch of both documents together."""
    return F.array_sort(F.array_union(one, other))


def likeness(one: Column, other: Column, same: Column) -> Column:
    """Estimated Jaccard similarity. Without any kept hash on either side: 1 for equal texts, else 0."""
    both = F.size(F.array_intersect(one, other))
    total = F.size(one) + F.size(other) - both
    return F.when(same, 1.0).when(total > 0, both / total).otherwise(0.0)


def written(text: Column, hashes: Column) -> Column:
    """A fingerprint as text: the hash of the whole text, then the sketch, in hexadecimal."""
    return F.concat(F.lower(F.hex(F.xxhash64(text))), F.lit(":"), F.lower(F.concat_ws(",", F.transform(hashes, lambda h: F.hex(h)))))


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """docs (doc_id, columns) with next_<column>: the values of the following row in ascending doc_id, after the last the first.

    Ranges of doc_id are windows of their own. Each range starts at an existing id, whose row is also put at the end of
    the range before, so no window needs to look into another and nothing is ordered globally. Rows without a doc_id
    have no next row; rows that share one follow each other, by the first of the columns.
    """
    ids = docs.where("doc_id IS NOT NULL")
    shares = [i / buckets for i in range(buckets)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 10000 * max(1, buckets // 500)).alias("b"), F.min("doc_id").alias("m")).first()
    bounds = sorted({*(found["b"] or [0]), *([found["m"]] if found["m"] is not None else [])})
    step = max(1, int(len(bounds) ** 0.5))
    every = F.array(*map(F.lit, bounds))
    coarse = F.array(*map(F.lit, bounds[::step]))
    below = lambda a: F.size(F.filter(a, lambda b: b <= F.col("doc_id")))
    first = (F.greatest(below(coarse), F.lit(1)) - 1) * step
    range_of = first + below(F.slice(every, first + 1, step)) - 1
    odd = -1 - F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")  # rows without id are spread by content
    placed = docs.select("doc_id", *columns, F.when(F.col("doc_id").isNull(), odd).otherwise(range_of).alias("range"))
    leads = F.get(every, F.col("range")) == F.col("doc_id")
    before = F.when(F.col("range") == 0, len(bounds) - 1).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range").alias("at"), F.lit(0).alias("copy"))
    ahead = F.struct(before.alias("at"), F.when(F.col("range") == 0, 2).otherwise(1).alias("copy"))
    both = placed.withColumn("place", F.explode(F.when(leads, F.array(own, ahead)).otherwise(F.array(own))))
    order = Window.partitionBy("place.at").orderBy(F.col("place.copy") == 2, "doc_id", columns[0])
    after = [F.when(F.col("doc_id").isNotNull(), F.lead(c).over(order)).alias(f"next_{c}") for c in columns]
    return both.select("doc_id", *columns, "place", *after).where("place.copy = 0").drop("place")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Sketches of each text of docs (doc_id, text; others are ignored) and of its edited text.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document's
    text in ascending doc_id. Null texts are empty; texts without words have an empty sketch. Rows without a doc_id
    no next document: the replaced half is gone and near_next is 0. A single document is its own next one. Repeated rows
    follow each other; texts are read whole at any length, in memory that grows with one text and the next. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("kept", sketch(F.col("text")))
    pairs = with_next(given, ["text", "kept"], 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half),
    )
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    pairs = pairs.withColumn("edited_kept", sketch(F.col("edited")))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("text"), F.col("kept")).alias("fingerprint"),
        written(F.col("edited"), F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(F.col("kept"), F.col("edited_kept"), F.col("text") == F.col("edited")).alias("near_edited"),
        F.coalesce(likeness(F.col("kept"), F.col("next_kept"), F.col("text") == F.col("next_text")), F.lit(0.0)).alias("near_next"),
    )
