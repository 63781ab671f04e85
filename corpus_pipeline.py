"""Corpus pipeline: documents to a training mix in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents; the last adds `copy`, the number of the copy.

Defined results, in every stage: an empty table gives an empty one; columns beside
doc_id, text and source pass through whatever their names (the last stage replaces
one named `copy`); rows are judged one by one by their own text, of any length. A null
text counts as empty: it gets a quality score like any other, is a near-duplicate of
other empty texts, holds no benchmark item and no personal data, and has size 0 in
the mix. Rows that repeat an id and a text are one group in near-dedup, of which one
row stays; rows without an id stay there. Ties have one order: the smallest id, then
the smallest hash. A null source is a source of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, mixing, near, pii, quality
from sparkloom.llm.shared import delete, scratch_dir, table, temporary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field accepts."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard 0.8 or more."""
    return near.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask(docs, pii.fit(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents by their source's repetition rate."""
    return mixing.emit(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("pii", pii_masking),
    ("source_mixing", source_mixing),
]

#: The field, the components and the span classifier aren't SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir.

    What a stage returns is written to the shared folder; it goes as soon as the
    next stage is written, with all that the stage wrote for itself.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{scratch_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{base}/{n}-{name}"
        with temporary():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete(spark, before)
        before = path
    return docs
