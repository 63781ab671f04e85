"""Work by partition in Python: batches of bounded size, with state from one to the next, and aggregates whose partial results merge."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

S = TypeVar("S")


def with_state(df: DataFrame, schema: str, start: Callable[[int], S], step: Callable[[S, pa.RecordBatch], pa.RecordBatch | None], finish: Callable[[S], pa.RecordBatch | None]) -> DataFrame:
    """What `step` makes of each batch of a partition, and `finish` of the state after the last one.

    start gets the partition's index. step may change the state; a batch is all of a
    partition that is held at a time. Rows come in the partition's order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start(TaskContext.get().partitionId())
        for batch in batches:
            if (made := step(state, batch)) is not None:
                yield made
        if (made := finish(state)) is not None:
            yield made

    return df.mapInArrow(run, schema)


def merged_aggregate(
    df: DataFrame, key: str, value: str, state: str, zero: Callable[[], Any], seq: Callable[[Any, Any], Any], comb: Callable[[Any, Any], Any], keys: int = 50_000
) -> DataFrame:
    """(key, state) by an aggregate of one's own: zero begins, seq adds a value, comb merges two states.

    As built-in aggregates do it: each task folds its rows into one state a key, giving out all it holds when
    that is `keys` of them, so that a hot key sends a few states and not its rows; then the states of a key are merged. comb must
    not depend on order. `state` is the type of a state. Null values are left to seq; a null key is a key.
    """
    kind = dict(df.dtypes)[key]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Any, Any] = {}
        schema = None

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), schema), pa.array(list(held.values()))], ["key", "state"])

        for batch in batches:
            schema = batch.column(0).type
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = seq(held[k] if k in held else zero(), v)
                if len(held) >= keys:
                    yield given()
                    held.clear()
        if held:
            yield given()

    @F.arrow_udf(state)
    def merge(states: pa.Array) -> Any:
        out = None
        for s in states.to_pylist():
            out = s if out is None else comb(out, s)
        return out

    partial = df.select(F.col(key).alias("key"), F.col(value).alias("value")).mapInArrow(fold, f"key {kind}, state {state}")
    return partial.groupBy("key").agg(merge("state").alias("state")).withColumnRenamed("key", key)
