"""Projections, CASE chains, codes and casts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import code, count_up, day, lookup, month, number_or, tiers
from sparkloom.plans.registry import query
from sparkloom.sources.tables import Tables

STATUS = {"F": "Fulfilled", "O": "Open"}


@query("SELECT c_custkey, c_name FROM customer")
def customer_names(t: Tables) -> DataFrame:
    return t.customer.select(t.customer.columns[0:2])


@query(
    "SELECT c_custkey, c_name || ' (' || c_mktsegment || ')' AS label, lower(c_name) || '@example.com' AS email, upper(c_mktsegment) AS segment, substr(c_name, 1, 1) AS initial FROM customer"
)
def customer_profile(t: Tables) -> DataFrame:
    return t.customer.select(
        "c_custkey", F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")")).alias("label"), F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.upper("c_mktsegment").alias("segment"), F.substring("c_name", 1, 1).alias("initial"),
    )


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 7500 THEN 'Platinum' WHEN c_acctbal >= 5000 THEN 'Gold' WHEN c_acctbal >= 2500 THEN 'Silver' ELSE 'Bronze' END AS tier FROM customer")
def customer_tier4(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tiers(F.col("c_acctbal"), [(7500, "Platinum"), (5000, "Gold"), (2500, "Silver")], "Bronze").alias("tier"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 7500 THEN 'High' WHEN c_acctbal >= 2500 THEN 'Medium' ELSE 'Low' END AS tier FROM customer")
def customer_tier3(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tiers(F.col("c_acctbal"), [(7500, "High"), (2500, "Medium")], "Low", strict=1).alias("tier"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'SMALL' WHEN o_totalprice < 250000 THEN 'MEDIUM' ELSE 'LARGE' END AS size FROM orders")
def order_size_case(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") < 50000, "SMALL").when(F.col("o_totalprice") < 250000, "MEDIUM").otherwise("LARGE").alias("size"))


@query("SELECT o_orderkey, round(o_totalprice, 0) AS rounded, CASE WHEN round(o_totalprice, 0) > 200000 THEN 'HIGH' ELSE 'NORMAL' END AS priority FROM orders WHERE o_orderstatus = 'O'")
def order_priority_case(t: Tables) -> DataFrame:
    rounded = t.orders.where(F.col("o_orderstatus") == "O").select("o_orderkey", F.round("o_totalprice", 0).alias("rounded"))
    return rounded.withColumn("priority", F.when(F.col("rounded") > 200000, "HIGH").otherwise("NORMAL"))


@query("SELECT o_orderkey, 'ORDER-' || substr(lpad(o_orderkey::VARCHAR, greatest(5, length(o_orderkey::VARCHAR))::INT, '0'), 1, 5) AS code FROM orders")
def order_code(t: Tables) -> DataFrame:
    """Five places, longer numbers cut as lpad does."""
    return t.orders.select("o_orderkey", code("ORDER-", F.col("o_orderkey"), cut=True).alias("code"))


@query("SELECT c_custkey, 'CUST-' || lpad(c_custkey::VARCHAR, greatest(5, length(c_custkey::VARCHAR))::INT, '0') AS code FROM customer")
def customer_code(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", code("CUST-", F.col("c_custkey")).alias("code"))


@query("SELECT o_orderkey, o_totalprice > 250000 AS high_value, o_totalprice > 15000 AS flagged FROM orders")
def order_flags(t: Tables) -> DataFrame:
    return t.orders.selectExpr("*", "o_totalprice > 250000 AS high_value").withColumn("flagged", F.col("o_totalprice") > F.lit(15000)).select("o_orderkey", "high_value", "flagged")


@query("SELECT l_orderkey, l_linenumber, round(l_quantity * l_extendedprice, 2) AS line_total FROM lineitem")
def line_total(t: Tables) -> DataFrame:
    return t.lineitem.withColumn("line_total", F.round(F.col("l_quantity") * F.col("l_extendedprice"), 2)).select("l_orderkey", "l_linenumber", "line_total")


@query("SELECT o_custkey, round(o_totalprice * 1.1::DOUBLE, 3) AS with_tax FROM orders")
def price_with_tax(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey", F.round(F.col("o_totalprice") * 1.1, 3).alias("with_tax"))


@query("SELECT count(DISTINCT k)::BIGINT AS n_keys, round(sum(v), 2) AS total FROM (SELECT o_custkey AS k, o_totalprice AS v FROM orders)")
def order_pairs(t: Tables) -> DataFrame:
    pairs = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"))
    return pairs.agg(F.countDistinct("k").alias("n_keys"), F.round(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' ELSE 'Unknown' END AS status_desc FROM orders")
def order_enriched(t: Tables) -> DataFrame:
    return t.orders.withColumn("status_desc", lookup(F.col("o_orderstatus"), STATUS, "Unknown")).select("o_orderkey", "status_desc")


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_totalprice AS amount FROM orders")
def order_renamed_dropped(t: Tables) -> DataFrame:
    names = {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_totalprice": "amount"}
    return t.orders.withColumnsRenamed(names).drop("o_orderstatus", "o_orderdate", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS month, coalesce(try_cast(o_orderpriority AS DOUBLE), 0) AS number FROM orders")
def order_casts(t: Tables) -> DataFrame:
    orders = t.orders
    return orders.select(
        orders.o_orderkey, orders["o_totalprice"].cast("float").cast("double").alias("price"), day(F.col("o_orderdate").cast("date")).alias("day"),
        month(F.col("o_orderdate")).alias("month"), number_or(F.col("o_orderpriority")).alias("number"),
    )


@query(
    "SELECT p_partkey, (p_size * 2)::BIGINT AS twice, (p_size * 3)::BIGINT AS thrice, (p_size + 10)::BIGINT AS plus10, (p_size * (p_size - 1) // 2)::BIGINT AS below, p_size::BIGINT AS n_list FROM part"
)
def derived_numbers(t: Tables) -> DataFrame:
    """Arithmetic, a chain of ten steps (one projection after optimization), a list of 0..n-1."""
    size = F.col("p_size").cast("long")
    out = t.part.select("p_partkey", (size * 2).alias("twice"), (size * 3).alias("thrice"), size.alias("plus10"), F.floor(size * (size - 1) / 2).alias("below"), F.size(count_up(size)).cast("long").alias("n_list"))
    for _ in range(10):
        out = out.withColumn("plus10", F.col("plus10") + 1)
    return out


@query(
    "SELECT o_orderkey, coalesce(year(try_strptime(raw, '%Y-%m-%d')) = 1996, false) AS in_1996, strftime(try_strptime(raw, '%Y-%m-%d'), '%Y-%m-%d') AS day "
    "FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw FROM orders)"
)
def dates_from_text(t: Tables) -> DataFrame:
    """Days parsed from text; what is no day is null and fails the test of its year."""
    key, date = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(key % 5 == 0, "n/a").when(key % 7 == 0, F.date_format(date, "dd.MM.yyyy")).otherwise(F.date_format(date, "yyyy-MM-dd"))
    day = F.try_to_date(raw, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", F.coalesce(F.year(day) == 1996, F.lit(False)).alias("in_1996"), F.date_format(day, "yyyy-MM-dd").alias("day"))


@query(
    "SELECT o_orderkey, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS due, year(o_orderdate)::INT AS year, (o_orderdate::DATE - DATE '1995-01-01')::INT AS age FROM orders"
)
def date_parts(t: Tables) -> DataFrame:
    day = F.to_date("o_orderdate")
    return t.orders.select("o_orderkey", F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("due"), F.year("o_orderdate").alias("year"), F.date_diff(day, F.lit("1995-01-01").cast("date")).alias("age"))


@query("SELECT p_partkey, power(p_size, 2)::DOUBLE AS square, round(sqrt(p_retailprice), 6) AS root FROM part")
def powers(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.pow("p_size", F.lit(2.0)).alias("square"), F.round(F.sqrt("p_retailprice"), 6).alias("root"))


@query(
    "SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS rank, split_part(o_orderpriority, '-', -1) AS name, regexp_replace(key || '_' || (o_orderkey % 4), '_[^_]*$', '') AS plain "
    "FROM (SELECT o_orderkey, o_orderpriority, 'k_' || (o_orderkey % 10) AS key FROM orders)"
)
def substring_forms(t: Tables) -> DataFrame:
    """Parts before the first and after the last mark; a salted key, which may hold the mark itself, less its last part."""
    key = F.col("o_orderkey")
    salted = F.concat(F.lit("k_"), (key % 10).cast("string"), F.lit("_"), (key % 4).cast("string"))
    priority = F.col("o_orderpriority")
    return t.orders.select("o_orderkey", F.substring_index(priority, "-", 1).alias("rank"), F.substring_index(priority, "-", -1).alias("name"), F.regexp_replace(salted, "_[^_]*$", "").alias("plain"))
