"""Sinks with side effects: metrics taken in the pass of a write, and a sink of one file a partition that retries can't double."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import csv, fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def observed_write(df: DataFrame, path: str, **metrics: Column) -> dict[str, Any]:
    """Write df as Parquet and return aggregates of what was written, taken in the same pass."""
    seen = Observation()
    df.observe(seen, *(c.alias(name) for name, c in metrics.items())).write.mode("overwrite").parquet(path)
    return seen.get


@dataclass
class Written(WriterCommitMessage):
    partition: int
    attempt: str
    rows: int


class PartitionFiles(DataSource):
    """Format `partition_files`: each partition streams its batches to one CSV file under the given path.

    A task writes to a name of its own, by partition and attempt. Only when all are done does the driver move
    the files of the attempts that Spark counted to part-NNNNN.csv and delete the rest, so a task
    that was lost, repeated or run twice at a time leaves one file. A failed job leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "partition_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return PartitionFilesWriter(self.options["path"])


class PartitionFilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self, name: str = "") -> tuple[fs.FileSystem, str]:
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return files, f"{root}/{name}" if name else root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        return self.put(iterator, context.partitionId(), str(context.taskAttemptId()))

    def put(self, batches: Iterator[pa.RecordBatch], partition: int, attempt: str) -> Written:
        """Stream one attempt's batches to its own file."""
        files, folder = self._at("_attempts")
        files.create_dir(folder, recursive=True)
        rows, writer = 0, None
        with files.open_output_stream(f"{folder}/{partition}-{attempt}") as stream:
            for batch in batches:
                writer = writer or csv.CSVWriter(stream, batch.schema)
                writer.write(batch)
                rows += batch.num_rows
            if writer:
                writer.close()
        return Written(partition, attempt, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = self._at("_attempts")
        for m in messages:
            if isinstance(m, Written) and m.rows:
                files.move(f"{folder}/{m.partition}-{m.attempt}", self._at(f"part-{m.partition:05d}.csv")[1])
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, folder = self._at("_attempts")
        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


def write_partitions(df: DataFrame, path: str) -> None:
    """One CSV file with a header for each partition that has rows."""
    df.sparkSession.dataSource.register(PartitionFiles)
    df.write.format("partition_files").mode("append").option("path", path).save()


def shown(df: DataFrame, n: int = 20, truncate: bool | int = True, vertical: bool = False) -> list[str]:
    """The lines that show() would print."""
    return df._show_string(n, truncate, vertical).rstrip("\n").split("\n")


def default_parallelism(spark: SparkSession) -> int:
    """Partitions of a table made in place where none are asked for."""
    return spark.range(1 << 20).select("id").rdd.getNumPartitions()
