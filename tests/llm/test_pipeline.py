"""The registered queries on a small folder, and the stages of the pipeline against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from perceptra.llm import queries

from ..oracle import SMALL, agree, connect
from . import brute


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    agree(queries.QUERIES[name](spark, SMALL), connect(), queries.ORACLES[name])


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {x.split("_")[0] + "_" for x in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= names


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{folder}/{name}")
        out.append((docs, docs := spark.read.parquet(f"{folder}/{name}")))
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{SMALL}/documents.parquet").columns
    assert all(after.columns == columns for _, after in stages[:-1])


def test_quality_stage_keeps_good_documents(spark, stages):
    before, after = stages[0]
    known = before.join(spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1"), "doc_id")
    sound = [r.doc_id for r in known.select("doc_id", "text").collect() if (c := brute.base_counts(r.text))[0] >= 20 and 100 * c[4] <= 30 * c[0]]
    kept = {r.doc_id for r in after.select("doc_id").collect()}
    assert len(kept & set(sound)) >= 0.95 * len(sound)


def test_duplicate_stages(stages):
    rows = [tuple(r) for r in stages[1][0].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in stages[1][1].collect()) == sorted({keep for _, keep, _, _ in brute.exact(rows)})
    rows = [tuple(r) for r in stages[2][0].select("doc_id", "text").collect()]
    assert sorted(r.doc_id for r in stages[2][1].collect()) == sorted(k for k, _, c in brute.components(rows) if k == c)


def test_mix_and_packing_stages(stages):
    before, after = stages[3]
    n = before.count()
    assert 0 < after.count() <= 2 * n and after.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = stages[4][1]
    texts = after.count()
    assert packed.where("start = 0").count() == texts


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["op3_mixing", "op5_sharding", "op8_url_filters", "op9_exact_dedup"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "MapInArrow", "MapInPandas", "Cartesian", "NestedLoop"))
