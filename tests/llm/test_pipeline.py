import pytest

import corpus_pipeline
from turnstone.llm import pipeline, quality

from .conftest import SF
from .test_neardup import brute


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name], docs = (docs, spark.read.parquet(f"{tmp_path}/{name}")), spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["quality classifier"]
    keep = {r.doc_id for r in quality.classify(before, quality.trusted(spark.read.parquet(f"{SF}/labels.parquet"))).where("keep").collect()}
    assert {r.doc_id for r in after.collect()} == keep and 0 < len(keep) < before.count()
    before, after = seen["near-duplicates"]
    classes = brute([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == set(classes.values()) and len(set(classes.values())) < len(classes)
    before, after = seen["surrogates"]
    assert before.count() == after.count()
    before, after = seen["source mix"]
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(texts[r.doc_id] == r.text for r in after.collect()) and after.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 3
    before, after = seen["packing"]
    total = after.agg({"length": "sum"}).first()[0]
    assert after.agg({"sequence_id": "max"}).first()[0] + 1 == -(-total // 4096)
    assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()


@pytest.fixture
def odd_dir(spark, docs, tmp_path):
    """Tables of the odd rows, with clashing columns and a row without doc_id."""
    odd = docs.selectExpr("nullif(doc_id, 8) as doc_id", "text", "lang", "source", "size", "1 as keep", "2 as mark", "3 as copies", "4 as n", "5 as queue", "6 as row")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_at_every_stage(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    counts = {}
    for name, function in pipeline.STAGES[:-1]:
        out = function(spark, docs, odd_dir)
        assert out.columns == docs.columns
        counts[name] = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    ids = lambda name: [i for none, i in counts[name] if not none]
    assert set(ids("quality classifier")) >= {1, 5, 6} and not {2, 3, 4} & set(ids("quality classifier"))
    # Texts without words are copies of each other; the repeated row is one; a row without doc_id stays.
    assert ids("near-duplicates") == [1, 2, 5, 6, 7] and (True, 0) in counts["near-duplicates"]
    assert len(counts["surrogates"]) == 9
    packed = pipeline.packed(spark, docs, odd_dir)
    assert packed.agg({"length": "sum"}).first()[0] > 9000


def test_run_on_odd_and_empty_tables(spark, odd_dir, no_docs, tmp_path):
    assert pipeline.run(spark, odd_dir).columns[:3] == ["doc_id", "start", "length"]
    empty = f"{tmp_path}/empty"
    no_docs.write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert pipeline.run(spark, empty).count() == 0
