"""The queries against their oracle SQL, and the pipeline as a whole."""

from collections import Counter

import pytest
from compare import connect, differences
from helpers import AWKWARD, stored

import corpus_pipeline
from usagelens.llm.registry import ORACLES, QUERIES
from usagelens.llm import queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        assert differences(df, connect(sf), ORACLES[name]) == []
    else:
        key, n = ("vec_id", 500) if "vec_id" in df.columns else ("doc_id", 200)
        assert {r[0] for r in df.select(key).collect()} == set(range(n))


def test_pipeline_stages(spark, tmp_path):
    docs = stored(spark, tmp_path, AWKWARD)
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, None)
        if name != "packing":
            assert docs.columns == columns
            folder = str(tmp_path / name)
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
            kept = Counter(str(r.doc_id) for r in docs.collect())
        if name == "language_id":
            assert not {"1", "2", "3"} & set(kept) and sum(kept.values()) == len(AWKWARD) - 4
        if name == "exact_dedup":
            assert kept == Counter(["None", "4", "4", "7", "8", "9", "10"])
        if name == "near_dedup":
            assert kept == Counter(["None", "4", "4", "7", "9", "10"])
        if name == "mixing":
            assert set(kept) <= {"None", "4", "7", "9", "10"} and max(kept.values()) <= 6
    assert Counter(str(r.doc_id) for r in docs.collect()).keys() == kept.keys()


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    docs = stored(spark, tmp_path, [])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, None)
        assert out.collect() == [] and (name == "packing" or out.columns == docs.columns)


def test_pipeline_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and all(r.length <= 1024 for r in rows)
