"""Windowed aggregates over events: one definition, run as a batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.registry import query
from sparkloom.sources.tables import Tables


def per_window(events: DataFrame, length: str = "1 day") -> DataFrame:
    """Events and their value per tumbling window and type."""
    grouped = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return grouped.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("s", 2).alias("total"))


def stream(spark: SparkSession, folder: str, schema: str, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """The same over a folder that gains files; windows close once the watermark has passed them, so state stays bounded."""
    source = spark.readStream.schema(schema).parquet(folder)
    return per_window(source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), length)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_per_day(t: Tables) -> DataFrame:
    return per_window(t.events)
