"""Sketch-bracketed percentiles, skew joins, bucketed joins, prefix sums, scratch folders."""

from __future__ import annotations

import random
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import layout, relational
from sparkloom.plans.catalogue import QUERIES

INF, NAN = float("inf"), float("nan")
SHARES = (0.0, 0.25, 0.5, 0.95, 1.0)
RANDOM = random.Random(4)
VALUES = {
    "none": [], "nulls": [None, None], "one infinite": [INF], "infinities": [INF, 1.0, 2.0, -INF], "nan": [NAN, 1.0, None, INF, -INF, 2.0], "all nan": [NAN] * 3, "equal": [5.0] * 50,
    "huge": [-INF] * 5 + [1.7e308, -1.7e308, 0.0], "outlier": [float(i) for i in range(900)] + [1e300], "ties": [1.0] * 400 + [2.0] * 3 + [3.0] * 400, "normal": [RANDOM.gauss(0, 1) for _ in range(5000)],
    "zeros": [0.0, -0.0] * 20 + [-1.0],
}


@pytest.mark.parametrize("name", VALUES)
def test_percentiles_are_exact(spark, name):
    values = sorted((v for v in VALUES[name] if v is not None), key=lambda v: (v != v, 0 if v != v else v))
    df = spark.createDataFrame([(v,) for v in VALUES[name]], "v double")
    want = {p: values[min(int(len(values) * p), len(values) - 1)] for p in SHARES} if values else {}
    # also with a sketch too small for its brackets, which are missed and doubled
    for options in ({}, {"k": 8, "error": 1e-3}):
        got = {r.share: r.v for r in relational.floor_percentiles(df, "v", SHARES, **options).collect()}
        assert {p: str(v + 0.0) for p, v in got.items()} == {p: str(v + 0.0) for p, v in want.items()}


def test_percentiles_of_other_types(spark):
    df = spark.range(1000).select(F.col("id").cast("int").alias("i"), (F.col("id") / 4).cast("decimal(12,2)").alias("d"))
    assert [r.i for r in relational.floor_percentiles(df, "i", (0.1, 0.9)).orderBy("share").collect()] == [100, 900]
    assert [float(r.d) for r in relational.floor_percentiles(df, "d", (0.1, 0.9)).orderBy("share").collect()] == [25.0, 225.0]


def test_percentiles_read_the_table_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).cast("double").alias("v")).mapInArrow(count, "v double")
    assert [r.v for r in relational.floor_percentiles(rows, "v", (0.5, 0.99)).orderBy("share").collect()]
    assert seen.value <= 2 * 20_000 * 2  # the second read's plan may scan its shuffled input once for sums and once for rows


def test_region_is_a_search(spark):
    points = sorted(RANDOM.sample(range(1000), 37))
    rows = spark.range(1000).select("id", relational.region(F.col("id").cast("double"), points).alias("r")).collect()
    assert all(r.r == sum(p <= r.id for p in points) for r in rows)


def skewed(spark, n=20_000):
    """Two thirds of the facts have one key, some none, the rest two thousand."""
    key = F.when(F.col("id") % 3 < 2, 7).when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.col("id") % 2000)
    return spark.range(n).select("id", key.cast("long").alias("key"))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_equals_the_plain_join(spark, how):
    facts = skewed(spark)
    dimension = spark.range(0, 1500).select(F.col("id").alias("key"), (F.col("id") * 2).alias("double")).unionByName(spark.createDataFrame([(7, -1), (None, 5)], "key long, double long"))
    want = sorted(map(str, facts.join(dimension, "key", how).select("id", "key", "double").collect()))
    for options in ({"rows": 1000}, {"rows": 1000, "salts": 4}, {"rows": 10**9}):
        assert sorted(map(str, layout.skew_join(facts, dimension, "key", how, **options).select("id", "key", "double").collect())) == want
    assert layout.skew_join(facts.limit(0), dimension, "key", how).count() == 0
    with pytest.raises(ValueError):
        layout.skew_join(facts, dimension, "key", "right")


@pytest.mark.parametrize("salts", [4, 8, 16])
def test_skew_join_deals_the_hot_key(spark, salts):
    """With shuffles forced, the largest partition holds little more than the hot key's rows over its salts; the plain join's holds all of them."""
    facts, dimension = skewed(spark), spark.range(2000).select(F.col("id").alias("key"), F.lit(1).alias("one"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        hot = facts.where("key = 7").count()
        joined = layout.skew_join(facts, dimension, "key", rows=1000, salts=salts, keep=True)
        assert largest(facts.join(dimension, "key")) >= hot
        assert {r[0]: r[1] for r in joined.groupBy((F.col("key") == 7).alias("hot")).agg(F.countDistinct("salt")).collect()} == {True: salts, False: 1}
        # two salts may meet in one of 64 partitions
        assert largest(joined) <= 4 * hot / salts + 600
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_bucketed_join_has_no_exchange(spark, sf_dir):
    df = QUERIES["join_bucketed"](spark, sf_dir)
    assert df.count() and "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_prefix_sums(spark):
    """Null values, ties in the first column, names that clash, one part and many, empty tables."""
    rows = [(RANDOM.choice([1, 1, 1, 2, None]), k, None if k % 7 == 0 else k) for k in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, v long").withColumns({"part_": F.lit("x"), "before_0": F.lit("y"), "c.d": F.lit("z")})
    want, total = {}, 0
    for n, (a, b, v) in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        total += v or 0
        want[b] = (total, n)
    for parts in (1, 7):
        out = relational.prefix_sums(df, ["a", "b"], {"s": F.col("v")}, parts)
        got = relational.global_position(out, ["a", "b"], "n", parts)
        assert got.columns == [*df.columns, "s", "n"]
        assert {r.b: (r.s, r.n) for r in got.collect()} == want and {r["part_"] for r in got.collect()} == {"x"}
    assert relational.prefix_sums(df.limit(0), ["a"], {"s": F.col("v")}).count() == 0


def test_running_sums_gather_parts_not_rows(spark, sf_dir):
    """The only one-task exchange stands over totals of parts."""
    for name in ("running_revenue", "running_per_order"):
        df = QUERIES[name](spark, sf_dir)
        plan = df._jdf.queryExecution().sparkPlan().toString()
        windows = [line for line in plan.splitlines() if "Window " in line]
        assert sum(bool(re.search(r"\], \[part_#\d+\], \[", w)) for w in windows) == 1, windows
        assert sum(bool(re.search(r"\], \[part_#\d+ ASC NULLS FIRST\]$", w)) for w in windows) == 1 and len(windows) == 2, windows


def test_nothing_is_left_after_the_session(tmp_path):
    """Scratch tables, prefix sums and buckets go with the driver's JVM."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.warehouse.dir", "{tmp_path}/warehouse").getOrCreate()
from sparkloom.operators import layout, relational
ranked = relational.global_position(spark.range(50), ["id"])
assert ranked.count() == 50 and layout.bucketed(spark.range(9), "id", 2).count() == 9
done = layout.written(spark.range(5), "gone")
layout.forget(done)
kept = layout.written(spark.range(5), "kept")
assert kept.count() == 5
spark.stop()
"""
    subprocess.run([sys.executable, "-c", script], check=True, capture_output=True, timeout=300)
    assert not [p for p in (tmp_path / "shared").rglob("*") if p.is_file()]
