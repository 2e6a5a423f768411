"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orbweave.llm import registry
from tests.llm.corpora import components, shingle_sets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return dict(out)


def test_stages_keep_the_columns(stages):
    names = list(stages)
    for n in names[1:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_quality_keeps_labelled_clean_documents(spark, stages, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    gone = labels.join(stages["quality"], "doc_id", "left_anti").count()
    assert gone <= 0.02 * labels.count()


def test_exact_and_near_stages_equal_brute_force(stages):
    before = [(r["doc_id"], r["text"]) for r in stages["quality"].select("doc_id", "text").collect()]
    last: dict = {}
    for i, t in before:
        last[t or ""] = max(i, last.get(t or "", i))
    assert {r["doc_id"] for r in stages["exact"].select("doc_id").collect()} == set(last.values())
    rows = [(r["doc_id"], r["text"]) for r in stages["exact"].select("doc_id", "text").collect()]
    want = components(shingle_sets(rows, 5), 80, 100)
    assert {r["doc_id"] for r in stages["near"].select("doc_id").collect()} == {i for i, c in want.items() if i == c}


def test_mix_and_packing_hold_every_word(stages):
    copies = stages["mix"].groupBy("doc_id").count()
    assert copies.agg(F.max("count")).first()[0] <= 2
    ends = stages["packed"].groupBy("doc_id").agg(F.count(F.when(F.col("piece") == 0, 1)).alias("count"))
    assert sorted(map(tuple, copies.collect())) == sorted(map(tuple, ends.collect()))
    fill = stages["packed"].groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.agg(F.max("n")).first()[0] <= 2048


def test_run_applies_all_stages(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages["packed"].count()


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(registry.ORACLES[name]).df()
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    want = want[list(got.columns)]
    assert sorted(map(repr, got.itertuples(index=False, name=None))) == sorted(map(repr, want.astype(got.dtypes.to_dict()).itertuples(index=False, name=None)))
