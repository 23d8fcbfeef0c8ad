import os

import corpus_pipeline
from larkspur.sources.paths import shared_dir
from tests.llm.fixtures import documents, empty


def test_stages_keep_the_columns(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == names
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3] > counts[4]
    kept = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "near_copies")).collect()}
    assert {r["doc_id"] for r in docs.collect()} == kept
    before = set(os.listdir(shared_dir(spark)))
    assert corpus_pipeline.run(spark, d).count() == docs.count()
    left = set(os.listdir(shared_dir(spark))) - before
    assert len(left) == 1 and left.pop().startswith("packing")


def test_odd_and_no_documents(spark):
    d = "/root/testdata/sf0.001"
    for df in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            df = stage(spark, df, d)
        df.collect()
