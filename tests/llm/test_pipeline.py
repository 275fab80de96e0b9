"""The pipeline's stages against the decisions of the operators alone."""

import corpus_pipeline
from weftmill.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    scores = {r["doc_id"] for r in queries.op6_quality(spark, sf_dir).where("predicted = 1").collect()}
    leaks = {r["doc_id"] for r in queries.op7_decontamination(spark, sf_dir).collect()}
    groups = {r["doc_id"]: r["component_id"] for r in queries.op9_simhash_dedup(spark, sf_dir).collect()}
    assert kept[0] == scores and kept[1] <= kept[0]
    assert len({groups[d] for d in kept[2]}) == len(kept[2]) and {groups[d] for d in kept[2]} == {groups[d] for d in kept[1]}
    assert kept[3] == kept[2] - leaks and kept[4] == kept[3]
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()} == kept[4]


def test_clashing_names(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)
    docs = docs.withColumns({c: F.lit(1) for c in ("score", "predicted", "rejected", "lang_pred", "fp", "root", "component_id", "found", "piece", "length", "offset", "k0")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 50


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
