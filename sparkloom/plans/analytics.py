"""Percentiles, RFM, cohorts, running totals, ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.exprs import day, month, tiers
from sparkloom.operators.layout import place, placed_counts
from sparkloom.operators.relational import floor_percentiles, global_position, prefix_sums, region
from sparkloom.plans.registry import query
from sparkloom.sources.tables import Tables

#: The reference date lies after all orders.
TODAY = "2001-12-31"
_RFM = (
    "SELECT o_custkey, date_diff('day', CAST({0}(o_orderdate) AS DATE), DATE '2001-12-31')::INT AS recency, count(*)::BIGINT AS frequency, round(sum(o_totalprice), 2) AS monetary "
    "FROM orders GROUP BY o_custkey"
)


@query(
    "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders) "
    "SELECT p::DOUBLE AS share, v AS price FROM r, (VALUES (0.25), (0.5), (0.75), (0.95)) s(p) WHERE k = floor(n * p::DOUBLE)"
)
def percentiles_floor(t: Tables) -> DataFrame:
    return floor_percentiles(t.orders, "o_totalprice", (0.25, 0.5, 0.75, 0.95)).withColumnRenamed("o_totalprice", "price")


def rfm(t: Tables, pick) -> DataFrame:
    """Days since the picked order, number of orders and sum, per customer."""
    since = F.datediff(F.lit(TODAY).cast("date"), pick("o_orderdate").cast("date"))
    return t.orders.groupBy("o_custkey").agg(since.alias("recency"), F.count("*").alias("frequency"), F.round(F.sum("o_totalprice"), 2).alias("monetary"))


@query(_RFM.format("min"))
def rfm_first(t: Tables) -> DataFrame:
    """Recency as days since the first order."""
    return rfm(t, F.min)


@query(_RFM.format("max"))
def rfm_last(t: Tables) -> DataFrame:
    """Recency as days since the last order."""
    return rfm(t, F.max)


def rfm_segment(recency: Column, frequency: Column, monetary: Column) -> Column:
    """Three scores of 1 to 3; their sum names the segment."""
    r = F.when(recency <= 1500, 3).when(recency <= 2100, 2).otherwise(1)
    f = F.when(frequency >= 10, 3).when(frequency >= 5, 2).otherwise(1)
    m = F.when(monetary >= 2_500_000, 3).when(monetary >= 1_000_000, 2).otherwise(1)
    return tiers(r + f + m, [(8, "Champion"), (6, "Loyal"), (4, "Potential")], "At Risk")


@query(
    f"SELECT CASE WHEN s >= 8 THEN 'Champion' WHEN s >= 6 THEN 'Loyal' WHEN s >= 4 THEN 'Potential' ELSE 'At Risk' END AS segment, count(*)::BIGINT AS n FROM (SELECT "
    f"CASE WHEN recency <= 1500 THEN 3 WHEN recency <= 2100 THEN 2 ELSE 1 END + CASE WHEN frequency >= 10 THEN 3 WHEN frequency >= 5 THEN 2 ELSE 1 END "
    f"+ CASE WHEN monetary >= 2500000 THEN 3 WHEN monetary >= 1000000 THEN 2 ELSE 1 END AS s FROM ({_RFM.format('min')})) GROUP BY ALL"
)
def rfm_segments(t: Tables) -> DataFrame:
    segment = rfm_segment(F.col("recency"), F.col("frequency"), F.col("monetary"))
    return rfm_first(t).groupBy(segment.alias("segment")).agg(F.count("*").alias("n"))


@query(
    "SELECT strftime(first, '%Y-%m') AS cohort, round(sum(o_totalprice), 2) AS revenue FROM (SELECT o_totalprice, min(o_orderdate) OVER (PARTITION BY o_custkey) AS first FROM orders) GROUP BY ALL ORDER BY cohort"
)
def cohort_revenue(t: Tables) -> DataFrame:
    """Revenue by the month of a customer's first order: partial sums per customer, no join back to the orders."""
    each = t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first"), F.sum("o_totalprice").alias("s"))
    return each.groupBy(month(F.col("first")).alias("cohort")).agg(F.round(F.sum("s"), 2).alias("revenue")).orderBy("cohort")


@query("SELECT DISTINCT o_custkey, strftime(min(o_orderdate) OVER (PARTITION BY o_custkey), '%Y-%m-%d') AS first_day FROM orders")
def first_order_per_customer(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(day(F.min("o_orderdate")).alias("first_day"))


@query(
    "SELECT day, revenue, round(sum(s) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS running FROM "
    "(SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, sum(o_totalprice) AS s, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1) ORDER BY day"
)
def running_revenue(t: Tables) -> DataFrame:
    """Running total over days: prefix sums over ranges of days, no window over all of them."""
    days = t.orders.groupBy(day(F.col("o_orderdate")).alias("day")).agg(F.sum("o_totalprice").alias("s"))
    summed = prefix_sums(days, ["day"], {"running": F.col("s")})
    return summed.select("day", F.round("s", 2).alias("revenue"), F.round("running", 2).alias("running")).orderBy("day")


@query(
    "SELECT o_orderkey, sum(cents) OVER w::BIGINT AS running_cents, (row_number() OVER w)::BIGINT AS orders_so_far FROM (SELECT o_orderkey, o_orderdate, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders) "
    "WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"
)
def running_per_order(t: Tables) -> DataFrame:
    """Two running sums over every order, by date and key: exact, as cents are whole."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = t.orders.select("o_orderkey", "o_orderdate", cents.alias("cents"))
    summed = prefix_sums(rows, ["o_orderdate", "o_orderkey"], {"running_cents": F.col("cents"), "orders_so_far": F.lit(1).cast("long")})
    return summed.select("o_orderkey", "running_cents", "orders_so_far")


@query(
    "WITH r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders), q AS (SELECT v FROM r, (VALUES (0.25), (0.5), (0.75)) s(p) WHERE k = floor(n * p::DOUBLE)) "
    "SELECT part::INT AS part, count(*)::BIGINT AS n FROM (SELECT (SELECT count(*) FROM q WHERE q.v <= o_totalprice) AS part FROM orders) GROUP BY part"
)
def partition_by_quartile(t: Tables) -> DataFrame:
    """Orders dealt to four partitions by ranges of price whose bounds the sketch and one count of its brackets give."""
    prices = t.orders.select("o_totalprice")
    bounds = [r["o_totalprice"] for r in floor_percentiles(prices, "o_totalprice", (0.25, 0.5, 0.75)).orderBy("share").collect()]
    return placed_counts(place(prices, 4, region(F.col("o_totalprice"), bounds)))


@query("SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1)::BIGINT AS position FROM orders")
def ranked_positions(t: Tables) -> DataFrame:
    return global_position(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
