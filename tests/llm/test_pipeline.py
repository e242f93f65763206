import __spark_entry__
import corpus_pipeline
from loomlog.llm.common import written


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


def test_stages(spark):
    """Each stage on what its predecessor kept; all but the last keep the columns of documents."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, folder), "t")
        counts.append(docs.count())
        assert i == 4 or docs.columns == columns
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0 and counts[5] > 0
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


def test_empty(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder), "t")
        assert docs.count() == 0
