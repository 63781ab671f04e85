"""The operators applied to the driver's tables: one query each, with the digest columns the contracts name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, licenses, maintext, media, mixing, pii, quality, simhash, toxicity, trie, warc
from .shared import table


def op1_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op2_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(docs, pii.fit(docs)).select("doc_id", *pii.OUT)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    records = chat.records_of(rows.unionByName(extra))
    return chat.digest(chat.render(chat.canonical(records)))


def op5_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(warc.resolve(warc.captures(table(spark, sf_dir, "pages"))))


def op6_mpeg_audio_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(table(spark, sf_dir, "documents")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(table(spark, sf_dir, "conversations"))


def op13_minimum_cut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return maintext.extract(pages, maintext.fit(pages))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_crf_quality,
        op2_pigeonhole_decontamination,
        op3_weak_supervision_pii,
        op4_chat_formatting,
        op5_revisit_resolution,
        op6_mpeg_audio_columns,
        op7_license_scan,
        op8_source_mixing,
        op9_simhash_gray_index,
        op10_factorization_machine_toxicity,
        op11_delta_lloyd_codes,
        op12_conversation_prefix_trie,
        op13_minimum_cut_main_text,
    )
}

#: Equivalent SQL, where SQL can express the operator.
ORACLES: dict[str, str] = {
    "op4_chat_formatting": chat.ORACLE_SQL,
    "op5_revisit_resolution": warc.ORACLE_SQL,
    "op8_source_mixing": mixing.ORACLE_SQL,
    "op11_delta_lloyd_codes": codes.ORACLE_SQL,
    "op12_conversation_prefix_trie": trie.ORACLE_SQL,
}
