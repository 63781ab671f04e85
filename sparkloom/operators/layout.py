"""Placement: salting, explicit partition ids, co-partitioning, caching, checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.exprs import salt


def salted_sum(df: DataFrame, key: str, value: str, row_id: Column, salts: int = 8, hot: list | Column | None = None) -> DataFrame:
    """(key, total) in two phases: by key and salt, then by key. With `hot`, keys or a condition, only those rows are salted.

    Sums combine map-side anyway; the salt matters for what can't (collect, joins)
    and is a column of its own, so keys of any form stay whole.
    """
    spread = salt(row_id, salts)
    if hot is not None:
        spread = F.when(F.col(key).isin(hot) if isinstance(hot, list) else hot, spread).otherwise(F.lit(0))
    first = df.groupBy(F.col(key), spread.alias("_salt")).agg(F.sum(value).alias("_part"))
    return first.groupBy(key).agg(F.sum("_part").alias("total"))


def hot_keys(df: DataFrame, key: str, above: int | Column) -> DataFrame:
    """Keys of more than `above` rows, as a table (never a driver-side list)."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > above)


def marked_hot(df: DataFrame, key: str, share: int = 4) -> DataFrame:
    """df with `hot`: whether its key has over 1 / share of all rows. Fewer than `share` keys can, so they are broadcast."""
    total = df.agg(F.count("*").alias("n")).scalar()
    hot = hot_keys(df, key, F.floor(total / share)).select(F.col(key).alias("_key"), F.lit(True).alias("_hot"))
    found = df.join(F.broadcast(hot), df[key].eqNullSafe(hot["_key"]), "left")
    return found.withColumn("hot", F.coalesce("_hot", F.lit(False))).drop("_key", "_hot")


#: Keys that skew_join salts are fewer than this.
HOT_KEYS = 100_000


def skew_join(facts: DataFrame, dimension: DataFrame, key: str, how: str = "inner", rows: int = 1_000_000, salts: int | None = None, row_id: Column | None = None, counted: DataFrame | None = None, keep: bool = False) -> DataFrame:
    """Join facts with the rows of dimension of the same key, where few keys may hold most facts.

    Keys of more than `rows` facts, and of more than one in HOT_KEYS of all, are found inside the plan, and each gets
    a salt for every so many of them (or `salts`); only their dimension rows are repeated, once a salt. All
    others, and null keys, which are dealt at random, join as they would. There are fewer such keys than
    HOT_KEYS, whatever the tables' size, so they are broadcast and no side is shuffled to find its salts. The salt is a hash of
    row_id, by default of all columns, so a task that is run again deals alike. how: inner or left (facts on the left).
    counted: a cheaper table with the same keys as often, to count by. keep: also give `salt`.
    """
    if how not in ("inner", "left"):
        raise ValueError("a repeated dimension can only be on the side whose own rows don't count")
    counts = (counted if counted is not None else facts).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_hot").isNotNull())
    least = F.greatest(F.lit(rows), F.coalesce(F.floor(counts.agg(F.sum("_n").alias("n")).scalar() / HOT_KEYS), F.lit(0)))
    share = F.lit(salts) if salts else F.ceil(F.col("_n") / least)
    salted = F.broadcast(counts.where(F.col("_n") > least).select("_hot", share.cast("int").alias("_salts")))
    deal = F.xxhash64(*([row_id] if row_id is not None else facts.columns))
    many = facts.join(salted, facts[key] == salted["_hot"], "left").drop("_hot")
    many = many.withColumn("_salt", F.when(F.col(key).isNull(), F.pmod(deal, F.lit(1 << 20))).otherwise(F.pmod(deal, F.coalesce("_salts", F.lit(1)))).cast("int")).drop("_salts")
    one = dimension.join(salted, dimension[key] == salted["_hot"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    one = one.drop("_hot", "_salts").withColumnRenamed(key, "_key")
    joined = many.join(one, (many[key] == one["_key"]) & (many["_salt"] == one["_copy"]), how).drop("_key", "_copy")
    return joined.withColumnRenamed("_salt", "salt") if keep else joined.drop("_salt")


def place(df: DataFrame, parts: int, part: Column) -> DataFrame:
    """Deal rows to the partition that an integer column names, and say so in `part`."""
    return df.withColumn("part", F.pmod(part, F.lit(parts)).cast("int")).repartitionById(parts, F.col("part"))


def placed_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per physical partition (and key), for rows dealt by place()."""
    return df.groupBy(F.spark_partition_id().alias("part"), *keys).agg(F.count("*").alias("n"))


def session_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def co_partition(left: DataFrame, right: DataFrame, key: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by key into as many partitions: joins and aggregates on the key need no shuffle of their own."""
    parts = parts or session_parts(left.sparkSession)
    return left.repartition(parts, key), right.repartition(parts, key)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """df saved in buckets of the key, sorted in each: joins and aggregates on the key read it without a shuffle.

    The table's name leaves the catalogue at once; its files are in the shared folder until the driver's JVM ends or forget().
    """
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    path = shared_path(spark, "bucketed")
    df.repartition(buckets, key).write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    table = spark.table(name).select("*")
    table.schema  # resolved while the name is known  # noqa: B018
    spark.sql(f"DROP TABLE {name}")
    table.written_path = path
    return table


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a session in one process gets a temporary one where none is set, a cluster an error."""
    context = spark.sparkContext
    where = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="sparkloom-")
        context.setCheckpointDir(where)
    return where.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself sees them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


#: Folders of applications that go when the driver's JVM ends.
_watched: set[str] = set()


def scratch_folder(spark: SparkSession) -> str:
    """This application's folder inside the shared one; what is left of it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/sparkloom/{spark.sparkContext.applicationId}"
    if path not in _watched:
        _watched.add(path)
        where, files = hadoop_path(spark, path)
        files.mkdirs(where)
        files.deleteOnExit(where)
    return path


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's scratch folder."""
    return f"{scratch_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage and fixes what was dealt by chance."""
    path = shared_path(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_path = path
    return table


def forget(df: DataFrame) -> None:
    """Delete what was written for df; only once nothing reads it any more."""
    path = df.__dict__.pop("written_path", None)
    if path:
        where, files = hadoop_path(df.sparkSession, path)
        files.delete(where, True)


def persisted(df: DataFrame, memory: bool = True, disk: bool = True) -> DataFrame:
    """Persist at a level; partitions that don't fit memory go to disk unless disk is off."""
    level = StorageLevel.MEMORY_AND_DISK if memory and disk else StorageLevel.MEMORY_ONLY if memory else StorageLevel.DISK_ONLY
    return df.persist(level)


def resized(df: DataFrame, parts: int, grow: bool = False) -> DataFrame:
    """More partitions by a shuffle, fewer by merging neighbours."""
    return df.repartition(parts) if grow else df.coalesce(parts)
