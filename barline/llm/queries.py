"""One query per operator, each over its whole table with the parameters meant for production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barline.llm import decontaminate, dedup, langid, licenses, mixing, privacy, secrets, sketch, tokencount, tokenids


#: The key of the surrogates in this query; users give their own, which nobody else should know.
KEY = "not a secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ecoc_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op2_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.encode_and_read(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op6_golden_ratio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.replace_personal_data(_table(spark, sf_dir, "documents"), KEY)


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprints(_table(spark, sf_dir, "documents"))


def op9_seed_and_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_copies(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES = (
    op1_ecoc_language_id,
    op2_range_coded_ids,
    op3_minhash_dedup,
    op4_license_compression,
    op5_secret_ownership,
    op6_golden_ratio_mix,
    op7_pii_surrogates,
    op8_scaled_sketch,
    op9_seed_and_align,
    op10_viterbi_token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


#: All pairs of documents by their shared shingles, then everything that is reachable.
DEDUP_SQL = """WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT links.y, reach.root FROM reach JOIN links ON links.x = reach.node),
least AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d LEFT JOIN sizes USING (doc_id) JOIN least ON least.node = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """The other operators learn, hash, compress or align in ways that SQL does not offer; tests/llm holds them against brute force."""
    return {"op3_minhash_dedup": DEDUP_SQL}
