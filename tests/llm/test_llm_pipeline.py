"""The pipeline against its stages done by hand on a small table."""

import numpy as np

import corpus_pipeline
from semaloom.llm import jaccard, mixing, packing, pii, quality


def test_stages_and_run(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    featured = quality.with_features(docs)
    scores = {r["doc_id"]: r["score"] for r in quality.scored(featured, quality.train(featured, labels)).collect()}
    rows = [r for r in docs.collect() if scores[r["doc_id"]] >= 0.5]
    from test_llm_documents import brute_components

    groups = brute_components([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]
    stage2 = spark.createDataFrame(rows, docs.schema)
    model = pii.learn(stage2)
    texts = {r["doc_id"]: pii.redacted(r["text"], pii.spans_of([r["text"]], model)[0][1]) for r in rows}
    stage3 = spark.createDataFrame([(r["doc_id"], texts[r["doc_id"]], r["lang"], r["source"], len(texts[r["doc_id"]])) for r in rows], docs.schema)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(stage3, [1.0, 2.0, 3.0]).collect()}
    encode = packing.encoder("byte_bpe_50k")
    got = corpus_pipeline.run(spark, sf_dir).collect()
    want = {i: copies[i] * -(-(len(encode(t)) + 1) // 2048) for i, t in texts.items() if copies[i]}
    found = {}
    for r in got:
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + 1
    assert found == want
    assert sum(r["length"] for r in got) == sum(copies[i] * (len(encode(t)) + 1) for i, t in texts.items())
    assert np.all([r["length"] <= 2048 for r in got]) and jaccard is not None


def test_stage_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("extra", F.when(F.col("doc_id") >= 0, F.lit(1)))
    nulls = spark.createDataFrame([(None, None, None, None, None, None), (10**6, None, "en", None, None, 2), (10**6, None, "en", None, None, 2)], docs.schema)
    rows = docs.unionByName(nulls)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == docs.columns and out.count() > 0, name
        assert stage(spark, rows.limit(0), sf_dir).count() == 0, name
