"""Predicates: every filter is a column expression that reaches the parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import within
from sparkloom.operators import layout
from sparkloom.plans.registry import query
from sparkloom.sources.tables import Tables

SHORT = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
_SHORT = ", ".join(SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_totalprice > 250000")
def orders_high_value(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice") > 250000).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def orders_status_and_price(t: Tables) -> DataFrame:
    return t.orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderstatus IN ('P', 'O') AND o_totalprice > 150000")
def orders_problem(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("P", "O") & (F.col("o_totalprice") > 150000)).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-11-01' AND o_orderdate < TIMESTAMP '2000-12-01'")
def orders_month(t: Tables) -> DataFrame:
    return t.orders.where(within(F.col("o_orderdate"), "2000-11-01", "2000-12-01")).select(*SHORT)


@query("SELECT count(*)::BIGINT AS n, (sum(o_orderkey))::BIGINT AS keys FROM orders WHERE o_orderkey % 10 = 0")
def orders_sample_mod(t: Tables) -> DataFrame:
    """A sample by key: repeatable, the same in any engine."""
    return t.orders.where(F.col("o_orderkey") % 10 == 0).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(None)
def orders_sample_seeded(t: Tables) -> DataFrame:
    """Bernoulli sample of a tenth, with a seed."""
    return t.orders.sample(False, 0.1, 42).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 50000 AND o_orderpriority = '1-URGENT'")
def orders_chained(t: Tables) -> DataFrame:
    """Three filters in a row; the optimizer makes one of them."""
    return t.orders.where(F.col("o_orderstatus") == "O").where(F.col("o_totalprice") > 50000).where(F.col("o_orderpriority") == "1-URGENT").select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderstatus <> 'P'")
def orders_not_status(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") != "P").select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_totalprice BETWEEN 50000 AND 250000")
def orders_between(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice").between(50000, 250000)).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-10-01' AND o_orderdate < TIMESTAMP '2001-01-01'")
def orders_quarter(t: Tables) -> DataFrame:
    return t.orders.where(within(F.col("o_orderdate"), "2000-10-01", "2001-01-01")).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-10-01' AND o_orderdate < TIMESTAMP '2001-01-01' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def orders_quarter_of_subset(t: Tables) -> DataFrame:
    """The same quarter, of one priority's larger orders only."""
    subset = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 100000))
    return subset.where(within(F.col("o_orderdate"), "2000-10-01", "2001-01-01")).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderdate >= TIMESTAMP '2000-06-01'")
def orders_since(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderdate") >= F.lit("2000-06-01").cast("timestamp_ntz")).select(*SHORT)


@query(f"SELECT {_SHORT} FROM orders WHERE o_orderstatus IN ('O', 'P')")
def orders_isin(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus").isin("O", "P")).select(*SHORT)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def customers_eq(t: Tables) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") == "BUILDING").select("c_custkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45")
def items_over_qty(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "SELECT count(*) FILTER (WHERE o.o_orderkey IS NULL)::BIGINT AS without_order, count(*) FILTER (WHERE o.o_orderkey IS NOT NULL)::BIGINT AS with_order "
    "FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-01-01') o ON c.c_custkey = o.o_custkey"
)
def null_keys_after_join(t: Tables) -> DataFrame:
    late = recent_urgent(t)
    joined = t.customer.join(late, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.agg(F.count_if(F.col("o_orderkey").isNull()).alias("without_order"), F.count_if(F.col("o_orderkey").isNotNull()).alias("with_order"))


@query(
    "SELECT lang, count(*)::BIGINT AS n FROM documents WHERE lang IN (SELECT lang FROM documents GROUP BY lang HAVING count(*) > (SELECT count(*) / 5 FROM documents)) GROUP BY lang"
)
def hot_keys_filter(t: Tables) -> DataFrame:
    """Rows of keys that hold over a fifth of all rows: a semi join with the table of such keys."""
    rows = t.documents.select("lang")
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.join(layout.hot_keys(rows, "lang", F.floor(total / 5)), "lang", "left_semi").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size FROM part WHERE p_partkey % 3 = 0")
def modulo_filter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_partkey") % 3 == 0).select("p_partkey", "p_size")


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000")
def having_total(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total")).where(F.col("total") > 2000000)
    return totals.withColumn("total", F.round("total", 2))


def recent_urgent(t: Tables) -> DataFrame:
    """Orders of one priority since 2001: leaves customers without an order."""
    return t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")))
