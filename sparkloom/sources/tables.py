"""The driver's tables as DataFrames, with the column subsets the queries need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Spark reads only the columns and row groups a query asks for."""
    if name not in NAMES:
        raise ValueError(f"no table {name!r}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Tables:
    """Tables of a folder as attributes: Tables(spark, dir).orders."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in NAMES:
            raise AttributeError(name)
        return load(self.spark, self.sf_dir, name)
