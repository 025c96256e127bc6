"""The pipeline's stages one by one on a small table."""

import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The documents before each stage, and what the last one gives."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stage')}/out"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes
    assert all(df.count() > 0 for df in stages)


def test_only_documents_without_a_language_go(stages):
    before, after = ({r["doc_id"]: r["text"] for r in df.collect()} for df in stages[:2])
    gone = set(before) - set(after)
    assert len(gone) <= 0.02 * len(before)
    assert all(re.search(r"[^\W\d_]", t) for t in after.values())


def test_one_of_each_group_stays(stages):
    from test_operators import groups, shingle_set

    before = {r["doc_id"]: shingle_set(r["text"]) for r in stages[1].collect()}
    kept = sorted(r["doc_id"] for r in stages[2].collect())
    assert kept == sorted({root for root in groups(before).values()})


def test_copies_of_the_benchmark_go(spark, stages):
    from test_operators import align

    from barline.llm import decontaminate

    items = [decontaminate.words_of(r["text"].encode()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in stages[3].collect()}
    for r in stages[2].collect():
        text = decontaminate.words_of(r["text"].encode())
        if len(text) > 300 and r["doc_id"] % 7:  # the full tables of long texts take long
            continue
        best = max((align(own, text) / (2 * len(own)) for own in items if len(set(own) & set(text)) * 3 > len(set(own))), default=0)
        assert (r["doc_id"] in kept) == (best < decontaminate.LEAST)


def test_mix_repeats_whole_documents(stages):
    before = {tuple(r) for r in stages[3].collect()}
    after = [tuple(r) for r in stages[4].collect()]
    assert set(after) <= before and max(map(after.count, set(after))) <= 3


def test_ids_follow_the_documents(stages):
    rows = sorted(stages[5].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted(r["doc_id"] for r in stages[4].collect())
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("stage", [stage for _, stage in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, stage):
    from test_operators import prose, table

    rng = random.Random(3)
    rows = [(i, prose(rng, 40), "a" if i % 2 else None, None if i % 5 else "s") for i in range(30)]
    rows += [(None, None, None, None), (None, rows[3][1], "a", "s"), (100, "", None, "s"), (101, None, "b", None), rows[3], rows[3]]
    docs = table(spark, rows).withColumn("lang_pred", F.lit("own")).withColumn("score", F.lit(1.5))
    for given in (docs, docs.limit(0)):
        got = stage(spark, given, SF)
        n = got.count()
        assert (n > 0) == (given is docs)
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert got.columns == docs.columns
            assert {(r["lang_pred"], r["_row"], r["score"]) for r in got.collect()} <= {("own", "clash", 1.5)}


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is not None and corpus_pipeline.ORACLE_SQL is None
