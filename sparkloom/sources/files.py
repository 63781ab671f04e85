"""Scans and sinks: CSV in four schema styles, text, local rows, parquet, side effects per partition."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The layouts of the e-commerce files.
CUSTOMERS = (
    "customerNumber long, customerName string, firstName string, lastName string, phone string, addressLine1 string, "
    "city string, state string, country string, creditLimit double, segment string"
)
ORDERS = (
    "orderNumber long, orderDate date, requiredDate date, status string, customerNumber long, amount double, paymentMethod string"
)
RETAIL = (
    "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate timestamp, UnitPrice double, CustomerId int, Country string"
)
RETAIL_TIME = "M/d/yyyy H:m"


def read_text(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """Lines as rows of `value`, in at least min_partitions partitions if that is given."""
    lines = spark.read.text(path)
    return lines.repartition(min_partitions) if min_partitions and lines.rdd.getNumPartitions() < min_partitions else lines


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, infer: bool = False, timestamps: str | None = None) -> DataFrame:
    """CSV with a header and proper quoting. An explicit schema saves the pass that inference needs; without either, strings."""
    reader = spark.read.option("header", True)
    if timestamps:
        reader = reader.option("timestampFormat", timestamps)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.csv(path, inferSchema=infer)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, overwriting; `single` makes one file and is for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Parquet, overwriting, optionally in a folder per value."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def local_rows(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table from the driver."""
    return spark.createDataFrame(list(rows), schema)


def numbers(spark: SparkSession, start: int, stop: int, partitions: int | None = None) -> DataFrame:
    """Integers [start, stop) as `id`, in a given number of partitions."""
    return spark.range(start, stop, 1, partitions)


def skewed_keys(spark: SparkSession, n: int, hot_share: float = 0.8, rare: int = 20, hot: str = "popular", prefix: str = "rare_") -> DataFrame:
    """(key, value): n rows of which the first hot_share have one key; the same at each evaluation."""
    cut = int(n * hot_share)
    key = F.when(F.col("id") < cut, F.lit(hot)).otherwise(F.concat(F.lit(prefix), ((F.col("id") - cut) % rare).cast("string")))
    return spark.range(n).select(key.alias("key"), F.col("id").alias("value"))


def sample_customers(spark: SparkSession, n: int = 1000) -> DataFrame:
    """n customers numbered from 1, drawn by hashes of their numbers: the same at each evaluation."""
    draw = lambda what, k: F.pmod(F.xxhash64("customerNumber", F.lit(what)), F.lit(k))
    rows = spark.range(1, n + 1).withColumnRenamed("id", "customerNumber")
    segment = F.element_at(F.array(*map(F.lit, ("Enterprise", "Premium", "Regular"))), (draw("segment", 3) + 1).cast("int"))
    name = F.concat(F.lit("Customer "), F.col("customerNumber").cast("string"))
    return rows.select("customerNumber", name.alias("customerName"), (draw("credit", 90_001) + 10_000).cast("double").alias("creditLimit"), segment.alias("segment"))


def sample_orders(spark: SparkSession, n: int = 5000, customers: int = 1000, first_day: str = "2024-01-01", days: int = 331) -> DataFrame:
    """n orders numbered from 1, with day, status, customer, amount and payment drawn by hashes."""
    draw = lambda what, k: F.pmod(F.xxhash64("orderNumber", F.lit(what)), F.lit(k))
    pick = lambda what, names: F.element_at(F.array(*map(F.lit, names)), (draw(what, len(names)) + 1).cast("int"))
    date = F.date_add(F.lit(first_day).cast("date"), draw("day", days).cast("int"))
    return spark.range(1, n + 1).withColumnRenamed("id", "orderNumber").select(
        "orderNumber", date.alias("orderDate"), date.alias("requiredDate"), pick("status", ("Shipped", "Processing", "On Hold", "Cancelled")).alias("status"),
        (draw("customer", customers) + 1).alias("customerNumber"), ((draw("amount", 990_001) + 10_000) / 100).alias("amount"),
        pick("payment", ("Credit Card", "PayPal", "Bank Transfer", "Cash")).alias("paymentMethod"),
    )


def each_partition(df: DataFrame, action: Callable[[Iterator[Row]], None]) -> None:
    """Run an action on the executors for the rows of each partition."""
    df.foreachPartition(action)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> list[Row]:
    """The first n rows in a total order."""
    return df.orderBy(*order).limit(n).collect()


def describe_schema(df: DataFrame) -> list[tuple[str, str]]:
    """Column names and types."""
    return df.dtypes
