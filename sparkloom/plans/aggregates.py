"""Aggregates, distinct values, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.exprs import day, month, salt
from sparkloom.operators.relational import number_stats, top_k
from sparkloom.plans.registry import query
from sparkloom.sources.tables import Tables

_STATS = "round(sum({0}), 2) AS total, count({0})::BIGINT AS n, round(avg({0}), 4) AS mean, min({0}) AS lowest, max({0}) AS highest, round(stddev_pop({0}), 3) AS deviation"


@query(f"SELECT {_STATS.format('c_acctbal')} FROM customer")
def global_stats(t: Tables) -> DataFrame:
    return t.customer.agg(*number_stats("c_acctbal"))


@query(f"SELECT o_orderstatus, {_STATS.format('o_totalprice')}, round(var_pop(o_totalprice), 0) AS variance FROM orders GROUP BY o_orderstatus")
def stats_by_status(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(*number_stats("o_totalprice"), F.round(F.var_pop("o_totalprice"), 0).alias("variance"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n, min(o_totalprice) AS lowest, max(o_totalprice) AS highest FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 5")
def customer_stats(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    stats = t.orders.groupBy("o_custkey").agg(F.sum(price).alias("s"), F.count("*").alias("n"), F.min(price).alias("lowest"), F.max(price).alias("highest"))
    return top_k(stats, 5, F.desc("s"), "o_custkey").select("o_custkey", F.round("s", 2).alias("total"), "n", "lowest", "highest")


@query("SELECT c_mktsegment, count(*)::BIGINT AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY c_mktsegment")
def avg_by_segment(t: Tables) -> DataFrame:
    balance = F.col("c_acctbal")
    return t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum(balance), 2).alias("total"), F.round(F.avg(balance), 4).alias("mean"))


@query("SELECT o_custkey, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_custkey ORDER BY avg(o_totalprice) DESC, o_custkey LIMIT 10")
def avg_per_customer_top10(t: Tables) -> DataFrame:
    means = t.orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return top_k(means, 10, F.desc("m"), "o_custkey").select("o_custkey", F.round("m", 4).alias("mean"))


@query("SELECT o_custkey, count(*)::BIGINT AS n, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), 1, 5), ',') AS first5 FROM orders GROUP BY o_custkey")
def orders_grouped(t: Tables) -> DataFrame:
    """How many values a key has, and the first five: one scan; each key and salt keeps five, then these are merged, so no list grows with a key."""
    rows = t.orders.select("o_custkey", "o_orderkey", salt(F.col("o_orderkey"), 8).alias("salt"))
    inside = Window.partitionBy("o_custkey", "salt")
    placed = rows.withColumn("n", F.count("*").over(inside)).withColumn("place", F.row_number().over(inside.orderBy("o_orderkey"))).where(F.col("place") <= 5)
    each = placed.groupBy("o_custkey", "salt").agg(F.first("n").alias("n"), F.sort_array(F.collect_list("o_orderkey")).alias("first"))
    merged = each.groupBy("o_custkey").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, 5).alias("first"))
    return merged.select("o_custkey", "n", F.array_join(F.transform("first", lambda k: k.cast("string")), ",").alias("first5"))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY o_custkey HAVING count(*) > 5")
def orders_per_customer(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).where(F.col("n") > 5)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY ALL ORDER BY month")
def monthly_revenue(t: Tables) -> DataFrame:
    return t.orders.groupBy(month(F.col("o_orderdate")).alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).orderBy("month")


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY ALL ORDER BY day")
def daily_revenue(t: Tables) -> DataFrame:
    return t.orders.groupBy(day(F.col("o_orderdate")).alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("revenue")).orderBy("day")


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY c_nationkey")
def group_sum(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders GROUP BY o_orderstatus")
def status_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, round(sum(p_retailprice), 2) AS total, round(avg(p_retailprice), 4) AS mean, count(p_retailprice)::BIGINT AS n FROM part GROUP BY p_brand")
def group_sum_avg_count(t: Tables) -> DataFrame:
    price = F.col("p_retailprice")
    return t.part.groupBy("p_brand").agg(F.round(F.sum(price), 2).alias("total"), F.round(F.avg(price), 4).alias("mean"), F.count(price).alias("n"))


@query("SELECT l_partkey, round(avg(l_quantity), 4) AS mean_qty FROM lineitem GROUP BY l_partkey")
def avg_qty_by_part(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 4).alias("mean_qty"))


@query("SELECT l_orderkey, round(avg(l_quantity), 4) AS mean_qty, round(stddev_pop(l_quantity), 4) AS dev_qty FROM lineitem GROUP BY l_orderkey")
def order_qty_stats(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.avg("l_quantity"), 4).alias("mean_qty"), F.round(F.stddev_pop("l_quantity"), 4).alias("dev_qty"))


@query("SELECT CASE WHEN o_totalprice < 50000 THEN 'SMALL' WHEN o_totalprice < 250000 THEN 'MEDIUM' ELSE 'LARGE' END AS size, count(*)::BIGINT AS n FROM orders GROUP BY ALL ORDER BY size")
def order_size_counts(t: Tables) -> DataFrame:
    size = F.when(F.col("o_totalprice") < 50000, "SMALL").when(F.col("o_totalprice") < 250000, "MEDIUM").otherwise("LARGE")
    return t.orders.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy("size")


@query("SELECT round(sum(l_quantity * l_extendedprice), 0) AS revenue, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * 1.1::DOUBLE), 1) AS with_tax, max(l_extendedprice * 2) AS top2 FROM lineitem")
def line_tax_total(t: Tables) -> DataFrame:
    out = t.lineitem.selectExpr("sum(l_quantity * l_extendedprice) AS revenue", "sum(l_quantity) AS qty", "sum(l_extendedprice * 1.1D) AS with_tax", "max(l_extendedprice * 2) AS top2")
    return out.select(F.round("revenue", 0).alias("revenue"), F.round("qty", 2).alias("qty"), F.round("with_tax", 1).alias("with_tax"), "top2")


@query("SELECT count(DISTINCT v)::BIGINT AS distinct_known, (SELECT count(*) FROM (SELECT DISTINCT v FROM x))::BIGINT AS distinct_rows, count(*) FILTER (WHERE v IS NULL)::BIGINT AS unknown FROM x".replace("FROM x)", "FROM (SELECT CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS v FROM customer))").replace("FROM x", "FROM (SELECT CASE WHEN c_nationkey > 20 THEN NULL ELSE c_nationkey END AS v FROM customer)"))
def distinct_vs_count(t: Tables) -> DataFrame:
    """countDistinct leaves null out, distinct keeps it."""
    values = t.customer.select(F.when(F.col("c_nationkey") <= 20, F.col("c_nationkey")).alias("v"))
    grouped = values.groupBy("v").agg(F.count("*").alias("k"))
    return grouped.agg(F.count("v").alias("distinct_known"), F.count("*").alias("distinct_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).cast("long").alias("unknown"))


@query("SELECT DISTINCT o_orderpriority FROM orders")
def distinct_values(t: Tables) -> DataFrame:
    return t.orders.select("o_orderpriority").distinct()


@query("SELECT count(p_retailprice)::BIGINT AS n, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS deviation, min(p_retailprice) AS lowest, max(p_retailprice) AS highest FROM part")
def describe_price(t: Tables) -> DataFrame:
    price = F.col("p_retailprice")
    return t.part.agg(F.count(price).alias("n"), F.round(F.avg(price), 4).alias("mean"), F.round(F.stddev_samp(price), 4).alias("deviation"), F.min(price).alias("lowest"), F.max(price).alias("highest"))


@query("SELECT month(o_orderdate)::INT AS month, count(*)::BIGINT AS n FROM orders GROUP BY ALL ORDER BY n DESC, month LIMIT 1")
def orders_by_month_number(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return top_k(counts, 1, F.desc("n"), "month")


@query("SELECT l_partkey, l_suppkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL ORDER BY qty DESC, l_partkey, l_suppkey LIMIT 4")
def top_parts(t: Tables) -> DataFrame:
    sums = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))
    return top_k(sums, 4, F.desc("qty"), "l_partkey", "l_suppkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey")
def orders_by_key(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top10_orders(t: Tables) -> DataFrame:
    return top_k(t.orders.select("o_orderkey", "o_totalprice"), 10, F.desc("o_totalprice"), "o_orderkey")
