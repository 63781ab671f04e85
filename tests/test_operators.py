"""Operators and expressions on hand-made frames: one case for each known trap."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.functions import exprs
from sparkloom.operators import layout, relational
from sparkloom.sources import files
from sparkloom.streaming import events


def column(spark, values, kind, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expression(F.col("v"))).collect()]


def test_csv_quotes_and_empty_values(spark, tmp_path):
    (tmp_path / "c.csv").write_text('city,state,country\n"London",,"UK"\n"Paris, 1er",,France\n')
    rows = files.read_csv(spark, str(tmp_path / "c.csv")).collect()
    assert [tuple(r) for r in rows] == [("London", None, "UK"), ("Paris, 1er", None, "France")]


def test_explicit_schema_turns_bad_values_into_null(spark, tmp_path):
    (tmp_path / "r.csv").write_text("InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerId,Country\nC1,a,b,x,1/2/2011 9:05,2.5,7,UK\n")
    row = files.read_csv(spark, str(tmp_path / "r.csv"), files.RETAIL, timestamps=files.RETAIL_TIME).first()
    assert (row.InvoiceNo, row.Quantity, row.UnitPrice, row.InvoiceDate) == ("C1", None, 2.5, dt.datetime(2011, 1, 2, 9, 5))


def test_sinks_round_trip(spark, tmp_path):
    df = files.local_rows(spark, [(1, "a"), (2, "b,c")], "id long, name string")
    files.write_csv(df, str(tmp_path / "csv"), single=True)
    files.write_parquet(df, str(tmp_path / "parquet"))
    files.write_parquet(df, str(tmp_path / "dealt"), "id")
    assert len(list((tmp_path / "csv").glob("part-*"))) == 1
    for back in (files.read_csv(spark, str(tmp_path / "csv"), df.schema), spark.read.parquet(str(tmp_path / "parquet")), spark.read.parquet(str(tmp_path / "dealt")).select("id", "name")):
        assert sorted(tuple(r) for r in back.collect()) == [(1, "a"), (2, "b,c")]
    assert files.read_text(spark, str(tmp_path / "csv"), 2).count() == 3
    assert files.first_rows(df, 1, F.desc("id"))[0].id == 2
    assert files.describe_schema(df) == [("id", "bigint"), ("name", "string")]
    seen = spark.sparkContext.accumulator(0)
    files.each_partition(df, lambda rows: seen.add(sum(r.id for r in rows)))
    assert seen.value == 3


def test_tiers_bounds(spark):
    steps = [(75, "High"), (25, "Medium")]
    assert column(spark, [76.0, 75.0, 25.0, 24.9], "double", lambda v: exprs.tiers(v, steps, "Low")) == ["High", "High", "Medium", "Low"]
    assert column(spark, [76.0, 75.0], "double", lambda v: exprs.tiers(v, steps, "Low", strict=1)) == ["High", "Medium"]


def test_codes(spark):
    assert column(spark, [7, 99999, 123456], "long", lambda v: exprs.code("C-", v)) == ["C-00007", "C-99999", "C-123456"]
    assert column(spark, [7, 123456], "long", lambda v: exprs.code("C-", v, cut=True)) == ["C-00007", "C-12345"]


def test_count_up_guards_zero(spark):
    assert column(spark, [0, 1, 3, -1], "long", exprs.count_up) == [[], [0], [0, 1, 2], []]


def test_words_letters_numbers(spark):
    assert column(spark, ["", "a  b", " é x"], "string", exprs.words) == [[], ["a", "b"], ["é", "x"]]
    assert column(spark, ["", "aé"], "string", exprs.letters) == [[], ["a", "é"]]
    assert column(spark, ["", "2.5", "x"], "string", exprs.number_or) == [0.0, 2.5, 0.0]


def test_bands_have_no_gaps(spark):
    assert column(spark, [2500.0, 2500.005, 2500.01, 7000.01], "double", lambda v: exprs.bands(v, (2500.0, 5000.0, 7000.0))) == [1, 1, 1, 3]


def test_initial_index(spark):
    assert column(spark, ["anna", "Zed", "1x", ""], "string", exprs.initial_index) == [0, 25, 0, 0]


def test_month_range_is_half_open_and_pushed(spark, sf_dir):
    from sparkloom.plans.catalogue import QUERIES

    plan = QUERIES["orders_month"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_floor_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in range(10)], "v double")
    got = {r.share: r.v for r in relational.floor_percentiles(df, "v", (0.0, 0.25, 0.5, 0.95)).collect()}
    assert got == {0.0: 0.0, 0.25: 2.0, 0.5: 5.0, 0.95: 9.0}
    one = spark.createDataFrame([(3.0,)], "v double")
    assert [r.v for r in relational.floor_percentiles(one, "v", (0.5,)).collect()] == [3.0]
    assert relational.floor_percentiles(df.limit(0), "v", (0.5,)).count() == 0
    ties = spark.createDataFrame([(5.0,)] * 7 + [(6.0,)], "v double")
    assert {r.share: r.v for r in relational.floor_percentiles(ties, "v", (0.5, 0.9)).collect()} == {0.5: 5.0, 0.9: 6.0}


def test_global_position(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r.v == r.position for r in relational.global_position(df, ["v"]).collect())


def test_lookup_join_and_match_kind(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "z"), (None, "n")], "id long, k string")
    names = spark.createDataFrame([("a", "A")], "k string, name string")
    assert sorted((r.k, r.name) for r in relational.lookup_join(facts, names, "k").collect()) == [("a", "A"), ("n", None), ("z", None)]
    kinds = facts.alias("f").join(names.alias("n"), F.col("f.k") == F.col("n.k"), "full").select(relational.match_kind(F.col("f.k"), F.col("n.k")).alias("m"))
    assert sorted(r.m for r in kinds.collect()) == ["both", "left_only", "left_only"]


def test_salted_sums_equal_plain(spark):
    df = files.skewed_keys(spark, 2000)
    plain = {r.key: r.s for r in df.groupBy("key").agg(F.sum("value").alias("s")).collect()}
    assert len(plain) == 21
    for hot in (None, ["popular"]):
        assert {r.key: r.total for r in layout.salted_sum(df, "key", "value", F.col("value"), 8, hot).collect()} == plain
    assert [r.key for r in layout.hot_keys(df, "key", 1000).collect()] == ["popular"]


def test_placement(spark, tmp_path):
    df = files.numbers(spark, 0, 100, 3)
    assert sorted((r.part, r.n) for r in layout.placed_counts(layout.place(df, 4, F.col("id"))).collect()) == [(k, 25) for k in range(4)]
    left, right = layout.co_partition(df, df, "id", 4)
    assert left.join(right, "id").count() == 100
    assert layout.written(df, "hundred").count() == 100
    assert layout.persisted(df, memory=False).count() == 100
    assert layout.resized(df, 8, grow=True).count() == layout.resized(df, 1).count() == 100
    assert layout.resized(df, 8, grow=True).rdd.getNumPartitions() == 8 and layout.resized(df, 1).rdd.getNumPartitions() == 1


def test_percentiles_with_an_outlier(spark):
    """One far value puts all others in one bucket; the next pass cuts that bucket."""
    df = spark.range(5000).select((F.col("id") / 7).alias("v")).unionByName(spark.createDataFrame([(1e15,), (None,)], "v double"))
    values = sorted(r.v for r in df.where("v IS NOT NULL").collect())
    got = {r.share: r.v for r in relational.floor_percentiles(df, "v", (0.0, 0.5, 0.95, 1.0), k=8).collect()}
    assert got == {p: values[min(int(len(values) * p), len(values) - 1)] for p in (0.0, 0.5, 0.95, 1.0)}


def test_bucketed_tables_join_without_a_shuffle(spark):
    left, right = (layout.bucketed(files.numbers(spark, 0, 100), "id", 4) for _ in "ab")
    joined = left.hint("merge").join(right, "id").groupBy("id").count()
    assert joined.count() == 100 and not [n for n in spark.catalog.listTables() if n.name.startswith("bucketed_")]
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_sample_tables_are_the_same_at_each_evaluation(spark):
    orders, customers = files.sample_orders(spark, 500, 50), files.sample_customers(spark, 50)
    assert orders.collect() == files.sample_orders(spark, 500, 50).collect() and customers.count() == 50
    low, high, n = orders.agg(F.min("amount"), F.max("amount"), F.count_if(F.col("orderDate").between("2024-01-01", "2024-11-26"))).first()
    assert 100 <= low < high <= 10_000 and n == 500 and orders.join(customers, "customerNumber").count() == 500
    assert {r.segment for r in customers.collect()} == {"Enterprise", "Premium", "Regular"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in table.dtypes)
    running = events.stream(spark, str(tmp_path / "in"), schema, late="40 days").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    try:
        running.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("windows").collect())
    finally:
        running.stop()
    assert got == sorted(tuple(r) for r in events.per_window(table).collect())
