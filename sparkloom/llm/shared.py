"""Helpers that several operators use: shared scratch tables, fresh column names, labelled samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.layout import hadoop_path, scratch_folder, shared_path

_held: ContextVar[list[DataFrame] | None] = ContextVar("held", default=None)

#: This application's folder of scratch tables.
scratch_dir = scratch_folder


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where, files = hadoop_path(spark, path)
    files.delete(where, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs no recomputation of what came
    before, and gives the planner the table's true size, by which it decides
    whether a side may be broadcast. release() deletes it, as does the end of temporary().
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.scratch_path = path
    held = _held.get()
    if held is not None:
        held.append(made)
    return made


def release(*tables: DataFrame | None) -> None:
    """Delete tables that materialise() wrote and nothing reads any more."""
    for made in tables:
        path = made.__dict__.pop("scratch_path", None) if made is not None else None
        if path:
            delete(made.sparkSession, path)


@contextmanager
def temporary() -> Iterator[None]:
    """Delete, at the end, what materialise() has written inside."""
    token = _held.set([])
    try:
        yield
    finally:
        release(*_held.get())
        _held.reset(token)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Names like those given that none of `taken` equals, whatever the case."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        found, n = name, 0
        while found.lower() in used:
            found, n = f"{name}_{n}", n + 1
        used.add(found.lower())
        out.append(found)
    return out


def own(df: DataFrame, name: str) -> Column:
    """A column by its whole name, dots and quotes in it meaning nothing."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame, *but: str) -> list[Column]:
    """All columns of df but those named."""
    return [own(df, c) for c in df.columns if c not in but]


def packed(df: DataFrame) -> Column:
    """All columns of df as one, so that names made beside it clash with none of them."""
    return F.struct(*columns(df)).alias("row")


def unpacked(df: DataFrame, *but: str) -> list[Column]:
    """The columns of df out of `row`, but those named."""
    return [F.col("row").getField(c).alias(c) for c in df.columns if c not in but]


def spread_join(many: DataFrame, one: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """many joined with the row of one that has the same key, a key's rows being dealt over `salts` tasks.

    one has a row for each key at most; it is repeated once for each salt, so no
    key, however many rows of many it has, meets in one task.
    """
    salt, other, theirs = fresh([*many.columns, *one.columns], "salt", "other_salt", "other_key")
    dealt = many.withColumn(salt, F.pmod(F.xxhash64(*columns(many)), F.lit(salts)))
    copies = one.withColumnRenamed(key, theirs).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, (dealt[key] == copies[theirs]) & (dealt[salt] == copies[other])).drop(salt, other, theirs)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The texts of a batch, one at a time; null is the empty text."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py() or ""


def held_out(doc_id: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label): at most per_class documents of either label; held-out ids never.

    First the per_class ids of either label with the smallest hashes; an id may
    have many rows, so of their different texts the first per_class of either
    label count, in order of hashes. The same at each run. Only ids and hashes,
    at most 2 * per_class rows, are ever broadcast; rows that repeat id and text
    are one.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .distinct()
        .withColumn("h", F.xxhash64("doc_id"))
    )

    def first(rows: DataFrame, *order: str) -> DataFrame:
        parts = [rows.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
        return parts[0].unionByName(parts[1])

    ids = first(known, "h", "doc_id")
    found = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))
    rows = found.drop("text").join(F.broadcast(ids), "doc_id").select("doc_id", "label", "h", "t").distinct()
    chosen = first(rows, "h", "doc_id", "t").select("doc_id", "label", "t")
    return found.join(F.broadcast(chosen), ["doc_id", "t"]).groupBy("doc_id", "label", "t").agg(F.first("text").alias("text")).select("doc_id", "text", "label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
