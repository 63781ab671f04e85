"""Scans and sinks: tables written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.layout import shared_path
from sparkloom.plans.registry import query
from sparkloom.sources import files
from sparkloom.sources.tables import Tables

_CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def _as_csv(t: Tables, single: bool = False) -> str:
    path = shared_path(t.spark, "customers-csv")
    files.write_csv(t.customer, path, single)
    return path


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_with_schema(t: Tables) -> DataFrame:
    """Written as CSV and read with an explicit schema: one pass, the types as they were."""
    return files.read_csv(t.spark, _as_csv(t), _CUSTOMER)


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_mktsegment")
def csv_inferred(t: Tables) -> DataFrame:
    """Read with inferred types, which costs a pass of its own."""
    rows = files.read_csv(t.spark, _as_csv(t, single=True), infer=True)
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey FROM customer")
def csv_as_strings(t: Tables) -> DataFrame:
    """Read without a schema: every column is text."""
    return files.read_csv(t.spark, _as_csv(t)).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT o_orderkey, o_orderdate AS at FROM orders")
def csv_timestamps(t: Tables) -> DataFrame:
    """Times in a format of their own."""
    path = shared_path(t.spark, "orders-csv")
    files.write_csv(t.orders.select("o_orderkey", F.date_format("o_orderdate", files.RETAIL_TIME).alias("at")), path)
    return files.read_csv(t.spark, path, "o_orderkey long, at timestamp", timestamps=files.RETAIL_TIME).select("o_orderkey", F.col("at").cast("timestamp_ntz").alias("at"))


@query("SELECT count(*)::BIGINT AS lines, sum(length(n_name))::BIGINT AS chars, 4 AS parts FROM nation")
def text_lines(t: Tables) -> DataFrame:
    """Lines of a text file, read in a given number of partitions at least."""
    path = shared_path(t.spark, "nations-text")
    t.nation.select("n_name").write.mode("overwrite").text(path)
    lines = files.read_text(t.spark, path, 4).withColumn("part", F.spark_partition_id())
    return lines.agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"), F.countDistinct("part").cast("int").alias("parts"))


@query("SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderpriority")
def parquet_by_status(t: Tables) -> DataFrame:
    """Written in a folder for each status; the filter reads one folder."""
    path = shared_path(t.spark, "orders-by-status")
    files.write_parquet(t.orders.select("o_orderstatus", "o_orderpriority"), path, "o_orderstatus")
    return t.spark.read.parquet(path).where(F.col("o_orderstatus") == "F").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT column_name AS name, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS type FROM (DESCRIBE customer)")
def schema_rows(t: Tables) -> DataFrame:
    """Names and types of a table's columns."""
    return files.local_rows(t.spark, files.describe_schema(t.customer), "name string, type string")


@query(
    "SELECT count(*)::BIGINT AS n, sum(i)::BIGINT AS total, count(o_orderkey)::BIGINT AS orders, 8 AS parts FROM (SELECT unnest(range((SELECT max(o_orderkey) + 1 FROM orders))) AS i) LEFT JOIN orders ON o_orderkey = i"
)
def number_range(t: Tables) -> DataFrame:
    """All integers up to the greatest order's key, made in place in eight partitions, and how many of them are an order's."""
    stop = (t.orders.agg(F.max("o_orderkey")).first()[0] or -1) + 1
    rows = files.numbers(t.spark, 0, stop, 8).withColumn("part", F.spark_partition_id())
    joined = rows.join(t.orders.select("o_orderkey"), F.col("id") == F.col("o_orderkey"), "left")
    return joined.agg(F.count("*").alias("n"), F.sum("id").alias("total"), F.count("o_orderkey").alias("orders"), F.countDistinct("part").cast("int").alias("parts"))
