"""From raw documents to token ids in five stages, each an operator of barline.llm on all rows that its predecessor kept.

Every stage but the last returns the columns of documents. A stage takes the session, the documents so far and the
folder of the tables, and returns a DataFrame; between stages the rows are written as Parquet and read again. Stages
take any columns beside those of documents along; what they do with nulls, empty tables and long texts is what their
operators do, which their docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import decontaminate, dedup, langid, mixing, tokenids
from barline.llm.queries import vocabulary
from barline.llm.tables import free_name, new_path

#: Least score of a language that a document is kept with.
LEAST_SCORE = 0.5
#: Words in a table of the last stage, fewer than where it runs alone: its executors have other stages behind them.
REMEMBERED = 1 << 18


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; it fills a missing lang. Rejected: no letters, or no language is likelier than all others together.

    A null text has no letters and goes; without any labelled row all go.
    """
    given = langid.with_held_out(docs.select("doc_id", "text", "lang"))
    names = {c: free_name(docs, f"_{c}") for c in ("lang_pred", "score", "ambiguous") if c in docs.columns}
    told = langid.identify(docs.withColumnsRenamed(names), langid.fit(given), tuple(names.get(c, c) for c in docs.columns))
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return told.where(sure).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*(F.col(names.get(c, c)).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id; of rows that share that id, the one whose text has the least hash.

    Rows without id stay. Null, empty and wordless texts are nobody's copies; an empty table stays empty.
    """
    kept = dedup.near_duplicates(docs).where("kept").select("doc_id").distinct()
    order = F.struct(F.xxhash64("text"), F.xxhash64(*docs.columns))
    some = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi")
    some = some.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
    return some.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copy of a benchmark item. Null and empty texts hold none; without items all documents stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_copies(docs, benchmark)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words; documents without words, as with null texts, are not taken."""
    return mixing.mixed_documents(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the written ids; null texts have the end id alone."""
    return tokenids.encode_and_read(docs, vocabulary("byte_bpe_50k.json"), REMEMBERED)


STAGES = [
    ("language identification", identify_languages),
    ("near-duplicate removal", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("source mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: The stages learn, align and tokenize, which SQL cannot express; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
