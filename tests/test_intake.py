"""Quarantine, observed writes, files by partition, skipping layouts, merging aggregates, state over batches."""

from __future__ import annotations

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.partitions import merged_aggregate, with_state
from sparkloom.plans import intake, merging
from sparkloom.plans.catalogue import QUERIES
from sparkloom.sources import sinks
from sparkloom.sources.quarantine import read_checked
from sparkloom.sources.skipping import scanned_rows, write_skippable


def test_quarantine(spark, tmp_path):
    """Quotes, line ends, empty values and lines, wrong types, dates, fields too few and too many; every line is in one table."""
    lines = ["1,a,2024-01-31,1.5", '2,"b, c",2024-02-01,2', '3,"d\n""e""",,', "4,f,2024-13-01,1", "5,g", "6,h,2024-01-01,1,x", "x,i,2024-01-01,1", '7,"j\nk",2024-01-01,many', ",,,"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    good, bad = read_checked(spark, str(tmp_path), "id long, name string, day date, price double")
    assert good.columns == ["id", "name", "day", "price"]
    assert sorted((r.id or 0, r.name, str(r.day), r.price) for r in good.collect()) == [(0, None, "None", None), (1, "a", "2024-01-31", 1.5), (2, "b, c", "2024-02-01", 2.0), (3, 'd\n"e"', "None", None)]
    assert sorted((r.raw, r.reason) for r in bad.collect()) == sorted([(lines[3], "type"), ("5,g", "short"), (lines[5], "long"), (lines[6], "type"), (lines[7], "type")])
    with pytest.raises(ValueError):
        read_checked(spark, str(tmp_path), "_raw string, b string")


def test_quarantine_of_split_files_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2\n")
    (tmp_path / "b.csv").write_text("id,name\n3,y\nz,w\n")
    good, bad = read_checked(spark, str(tmp_path), "id long, name string", header=True, multiline=False)
    assert sorted(tuple(r) for r in good.collect()) == [(1, "x"), (3, "y")]
    assert sorted(tuple(r) for r in bad.collect()) == [("2", "short"), ("z,w", "type")]


def test_no_order_line_is_lost(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    good, bad = (QUERIES[k](spark, sf_dir).count() for k in ("csv_good_rows", "csv_quarantine"))
    assert good + bad == n and bad == n * 4 // 10


def test_observed_write_takes_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(1000).mapInArrow(count, "id long")
    got = sinks.observed_write(rows, str(tmp_path / "out"), n=F.count(F.lit(1)), total=F.sum("id"), none=F.max(F.when(F.col("id") < 0, 1)))
    assert got == {"n": 1000, "total": 499_500, "none": None} and seen.value == 1000
    assert sinks.observed_write(rows.limit(0), str(tmp_path / "empty"), n=F.count(F.lit(1)))["n"] == 0


def test_partition_files(spark, tmp_path):
    sinks.write_partitions(spark.range(0, 100, 1, 5).where("id >= 20"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"part-{k:05d}.csv" for k in range(1, 5)]
    assert sorted(r.id for r in spark.read.csv(str(tmp_path / "out"), header=True, schema="id long").collect()) == list(range(20, 100))


def test_partition_files_survive_repeated_attempts(tmp_path):
    """A lost attempt, one run twice and one that fails half-way leave what Spark counted, or nothing."""
    batch = pa.RecordBatch.from_pydict({"id": [1, 2]})

    def broken():
        yield batch
        raise OSError("executor lost")

    writer = sinks.PartitionFilesWriter(f"file://{tmp_path}/out")
    with pytest.raises(OSError):
        writer.put(broken(), 0, "1")
    kept = [writer.put(iter([batch, batch]), 0, "2"), writer.put(iter([batch]), 1, "3"), writer.put(iter([]), 2, "5")]
    writer.put(iter([batch]), 1, "4")
    writer.commit(kept)
    assert {p.name: p.read_text() for p in (tmp_path / "out").iterdir()} == {"part-00000.csv": '"id"\n1\n2\n1\n2\n', "part-00001.csv": '"id"\n1\n2\n'}
    failed = sinks.PartitionFilesWriter(f"{tmp_path}/failed")
    failed.put(iter([batch]), 0, "1")
    failed.abort([None])
    assert list((tmp_path / "failed").iterdir()) == []


@pytest.mark.parametrize("condition", ["k IN (5, 49000)", "k BETWEEN 700 AND 720", "other = 777", "other IN (3, 4)"])
def test_lookups_read_few_rows(spark, tmp_path, condition):
    rows = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") * 7919 % 25_000).alias("other"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    write_skippable(rows, str(tmp_path / "t"), "k", ["other"], distinct=2000, group_bytes=64 << 10, page_rows=500)
    found = spark.read.parquet(str(tmp_path / "t")).where(condition)
    assert sorted(r.k for r in found.collect()) == sorted(r.k for r in rows.where(condition).collect())
    assert 0 < scanned_rows(found) < 50_000 / 4


def test_registered_lookups_skip(spark):
    """At a size with several row groups the registered lookups skip; two customers' twenty orders stand in half of the row groups."""
    tables = SimpleNamespace(spark=spark, orders=spark.read.parquet("/root/testdata/sf0.1/orders.parquet"))
    n = tables.orders.count()
    assert scanned_rows(intake.lookup_sorted(tables)) < n / 10
    assert scanned_rows(intake.lookup_bloom(tables)) < 2 * n / 3


def test_merged_sketches_keep_their_bound(spark):
    orders = spark.range(60_000).select((F.col("id") * 7919 % 30_011).alias("o_custkey"), F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(int(id % 700))").alias("o_orderdate"))
    tables = SimpleNamespace(orders=orders)
    rows = merging.distinct_by_period(tables).collect()
    assert all(r.within_bound for r in rows) and {r.period for r in rows} >= {"2020-02", "2020-Q1", "2021"} and max(r.customers for r in rows) > 19_000
    exact = orders.selectExpr("o_custkey", "date_trunc('month', o_orderdate) AS m").distinct()
    both = exact.alias("a").join(exact.alias("b"), F.expr("a.o_custkey = b.o_custkey AND b.m = add_months(a.m, 1)")).groupBy(F.expr("date_format(b.m, 'yyyy-MM')")).count()
    assert {r[0]: r[1] for r in both.collect()} == {r.month: r.returning_customers for r in merging.returning_customers(tables).collect()}


def test_returning_customers_are_exact_in_large_months(spark):
    """100,000 customers a month, 40,000 of them in both: more than a sketch of 65,536 entries holds; rows without a key or a date count nowhere."""
    rows = spark.range(200_000).selectExpr("id % 100000 + IF(id < 100000, 0, 60000) AS o_custkey", "IF(id < 100000, timestamp_ntz'2020-12-31', timestamp_ntz'2021-01-01') AS o_orderdate")
    orders = rows.unionByName(rows.limit(5)).unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS o_custkey, explode(array(timestamp_ntz'2020-12-01', timestamp_ntz'2021-01-01', NULL)) AS o_orderdate"))
    assert [tuple(r) for r in merging.returning_customers(SimpleNamespace(orders=orders)).collect()] == [("2021-01", 40_000)]


def test_merge_in_any_order(spark):
    rng = random.Random(3)
    for _ in range(200):
        values = [rng.randint(0, 9) for _ in range(rng.randint(0, 12))]
        parts = [values[k::3] for k in range(3)]
        rng.shuffle(parts)
        states = []
        for part in parts:
            state = []
            for v in part:
                state = merging.keep_three(state, v)
            states.append(state)
        assert merging.join_threes(merging.join_threes(*states[:2]), states[2]) == sorted(set(values), reverse=True)[:3] == merging.join_threes(states[2], merging.join_threes(states[1], states[0]))


def test_merged_aggregate(spark):
    """A hot key, a null key, null values, more keys than a task holds, an empty table."""
    rows = [(0, k % 50) for k in range(3000)] + [(k, k) for k in range(1, 400)] + [(None, 1), (None, None), (5, None)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    want = {}
    for k, v in rows:
        want.setdefault(k, set()).update({v} - {None})
    for keys in (10, 50_000):
        got = merged_aggregate(df, "k", "v", "array<long>", list, merging.keep_three, merging.join_threes, keys)
        assert {r.k: r.state for r in got.collect()} == {k: sorted(v, reverse=True)[:3] for k, v in want.items()}
    assert merged_aggregate(df.limit(0), "k", "v", "array<long>", list, merging.keep_three, merging.join_threes).count() == 0


def test_state_goes_from_batch_to_batch(spark):
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:

        def step(state, batch):
            state["batches"] += 1
            state["sum"] += sum(batch.column(0).to_pylist())
            return None

        def finish(state):
            return pa.RecordBatch.from_pydict({k: [v] for k, v in state.items()}) if state["batches"] else None

        got = with_state(spark.range(0, 100, 1, 4), "part long, batches long, sum long", lambda p: {"part": p, "batches": 0, "sum": 0}, step, finish).collect()
        assert sorted(tuple(r) for r in got) == [(k, 4, sum(range(25 * k, 25 * k + 25))) for k in range(4)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_shown_and_parallelism(spark):
    df = spark.createDataFrame([(1, "abcdefgh")], "id long, name string")
    assert sinks.shown(df, truncate=False)[3] == "|1  |abcdefgh|" and sinks.shown(df, truncate=5)[3] == "|  1|ab...|" and sinks.shown(df, vertical=True)[1].split("|")[0] == " id   "
    assert sinks.default_parallelism(spark) == spark.sparkContext.defaultParallelism
