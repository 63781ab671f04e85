"""The pipeline against the stages' decisions made one by one in plain Python."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, mixing, pii, quality
from test_near import brute_kept


def test_stages_and_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "pii", "source_mixing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = docs.unionByName(docs.limit(3)).unionByName(docs.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for given in (odd, docs.limit(0)):
            out = stage(spark, given, sf_dir)
            assert out.columns == docs.columns and out.count() <= given.count()


def test_run_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: r for r in docs.collect() if next(model.scores(iter([r.text]))) >= 0.7}
    keep = brute_kept({i: r.text for i, r in rows.items()})
    items = decontaminate.PieceIndex([(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    keep = [i for i in keep if not items.search([decontaminate.normal(rows[i].text)])]
    left = spark.createDataFrame([rows[i] for i in keep], docs.schema)
    masked = pii.mask(left, pii.fit(left))
    want = sorted((r.doc_id, r.text, r.copy) for r in mixing.emit(masked).collect())
    got = sorted((r.doc_id, r.text, r.copy) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert 0 < len(keep) < len(rows) < docs.count() and got == want
