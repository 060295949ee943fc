"""Each stage on its own input, and the whole run."""
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[2] < sizes[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    key = ["doc_id", "piece", "start", "length"]
    assert sorted(map(tuple, packed.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect()))
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_take_edges(spark, edge, nothing):
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    for start in (edge, nothing):
        docs = start.select(keep)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
            assert docs.columns == keep
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
