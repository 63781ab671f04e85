"""Joins: each query is one declarative plan; the planner picks the strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import layout
from sparkloom.operators.relational import lookup_join, match_kind, top_k
from sparkloom.plans.filters import recent_urgent
from sparkloom.plans.registry import query
from sparkloom.sources.files import local_rows
from sparkloom.sources.tables import Tables

_LATE = "(SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '2001-01-01')"
STATUS_ROWS = [("F", "Fulfilled"), ("O", "Open")]


def customers_with_orders(t: Tables, segment: str | None = None) -> DataFrame:
    """(o_custkey, c_name, c_nationkey, c_mktsegment, o_orderkey, o_totalprice)."""
    customers = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    if segment:
        customers = customers.where(F.col("c_mktsegment") == segment)
    orders = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")


@query(
    "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' "
    "GROUP BY c_custkey, c_name ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10"
)
def top_segment_spenders(t: Tables) -> DataFrame:
    """Flagship: one filter below one join, one aggregate by id and name, ten rows kept per task."""
    spent = customers_with_orders(t, "BUILDING").groupBy("o_custkey", "c_name").agg(F.sum("o_totalprice").alias("s"))
    return top_k(spent, 10, F.desc("s"), "o_custkey").select(F.col("o_custkey").alias("c_custkey"), "c_name", F.round("s", 2).alias("total"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def join_inner(t: Tables) -> DataFrame:
    return customers_with_orders(t).select("o_orderkey", "c_name", "o_totalprice")


@query(
    f"SELECT count(*)::BIGINT AS row_count, count(*) FILTER (WHERE o_orderkey IS NOT NULL)::BIGINT AS matched_rows, count(*) FILTER (WHERE o_orderkey IS NULL)::BIGINT AS unmatched_rows, "
    f"count(DISTINCT CASE WHEN o_orderkey IS NOT NULL THEN c_custkey END)::BIGINT AS matched_customers FROM customer LEFT JOIN {_LATE} o ON c_custkey = o_custkey"
)
def join_left_counts(t: Tables) -> DataFrame:
    """Rows and distinct customers are different counts, so both are given."""
    joined = t.customer.select("c_custkey").join(recent_urgent(t).select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left")
    found = F.col("o_orderkey").isNotNull()
    return joined.agg(
        F.count("*").alias("row_count"), F.count_if(found).alias("matched_rows"), F.count_if(~found).alias("unmatched_rows"),
        F.countDistinct(F.when(found, F.col("c_custkey"))).alias("matched_customers"),
    )


@query(f"SELECT count(*)::BIGINT AS row_count, count(*) FILTER (WHERE o_orderkey IS NULL)::BIGINT AS without_order FROM {_LATE} o RIGHT JOIN customer ON c_custkey = o_custkey")
def join_right_counts(t: Tables) -> DataFrame:
    joined = recent_urgent(t).select("o_custkey", "o_orderkey").join(t.customer.select("c_custkey"), F.col("c_custkey") == F.col("o_custkey"), "right")
    return joined.agg(F.count("*").alias("row_count"), F.count_if(F.col("o_orderkey").isNull()).alias("without_order"))


@query(
    f"SELECT CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_orderkey IS NULL THEN 'left_only' ELSE 'both' END AS kind, count(*)::BIGINT AS n "
    f"FROM (SELECT * FROM customer WHERE c_nationkey < 20) c FULL JOIN {_LATE} o ON c_custkey = o_custkey GROUP BY ALL"
)
def join_full_class(t: Tables) -> DataFrame:
    some = t.customer.where(F.col("c_nationkey") < 20).select("c_custkey")
    joined = some.join(recent_urgent(t).select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "full")
    return joined.groupBy(match_kind(F.col("c_custkey"), F.col("o_orderkey")).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT r_name, n_name FROM (SELECT r_name FROM region ORDER BY r_regionkey LIMIT 3), (SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 3)")
def cross_small(t: Tables) -> DataFrame:
    """All pairs of three and three rows."""
    return top_k(t.region, 3, "r_regionkey").select("r_name").crossJoin(top_k(t.nation, 3, "n_nationkey").select("n_name"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_nationkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def self_join_nation(t: Tables) -> DataFrame:
    left, right = (t.supplier.select(F.col("s_suppkey").alias(k), "s_nationkey") for k in "ab")
    return left.join(right.withColumnRenamed("s_nationkey", "n"), (F.col("s_nationkey") == F.col("n")) & (F.col("a") < F.col("b"))).drop("n")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fulfilled' WHEN 'O' THEN 'Open' ELSE 'Unknown' END AS description FROM orders")
def broadcast_lookup(t: Tables) -> DataFrame:
    names = local_rows(t.spark, STATUS_ROWS, "o_orderstatus string, description string")
    return lookup_join(t.orders.select("o_orderkey", "o_orderstatus"), names, "o_orderstatus").select("o_orderkey", F.coalesce("description", F.lit("Unknown")).alias("description"))


@query(
    "SELECT r_name, n_name, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"
)
def multiway_join(t: Tables) -> DataFrame:
    """Orders are summed per nation key first, so the dimensions join 25 rows."""
    by_nation = customers_with_orders(t).groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    named = by_nation.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return named.groupBy("r_name", "n_name").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("total"))


@query(f"SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM {_LATE} o)")
def never_ordered(t: Tables) -> DataFrame:
    return t.customer.join(recent_urgent(t), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query(
    "SELECT c_custkey, c_name, n_name, c_mktsegment, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n, round(avg(o_totalprice), 4) AS mean "
    "FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL ORDER BY sum(o_totalprice) DESC, c_custkey LIMIT 10"
)
def customer_summary_top10(t: Tables) -> DataFrame:
    spent = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"), F.count("*").alias("n"))
    known = spent.join(t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    best = top_k(known, 10, F.desc("s"), "o_custkey")
    named = best.join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("o_custkey").alias("c_custkey"), "c_name", "n_name", "c_mktsegment", F.round("s", 2).alias("total"), "n", F.round(F.try_divide("s", "n"), 4).alias("mean"))


def nation_revenue(t: Tables) -> DataFrame:
    sums = customers_with_orders(t).groupBy("c_nationkey").agg(F.sum("o_totalprice").alias("s"))
    return sums.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "s")


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY revenue DESC")
def revenue_by_nation(t: Tables) -> DataFrame:
    return nation_revenue(t).select("n_name", F.round("s", 2).alias("revenue")).orderBy(F.desc("revenue"))


@query("SELECT n_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY sum(o_totalprice) DESC, n_name LIMIT 1")
def top_nation(t: Tables) -> DataFrame:
    return top_k(nation_revenue(t), 1, F.desc("s"), "n_name").select("n_name", F.round("s", 2).alias("revenue"))


@query(
    "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_nationkey = 3 GROUP BY ALL HAVING sum(o_totalprice) > 2000000"
)
def nation_big_spenders(t: Tables) -> DataFrame:
    spent = customers_with_orders(t).where(F.col("c_nationkey") == 3).groupBy("o_custkey", "c_name").agg(F.sum("o_totalprice").alias("s")).where(F.col("s") > 2000000)
    return spent.select(F.col("o_custkey").alias("c_custkey"), "c_name", F.round("s", 2).alias("total"))


@query("SELECT c_custkey, c_name, total FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey")
def agg_join_back(t: Tables) -> DataFrame:
    totals = t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return totals.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "total")


@query("SELECT c_custkey, count(*)::BIGINT AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_copartitioned(t: Tables) -> DataFrame:
    """Both sides dealt by the key once; join and aggregate need no shuffle of their own."""
    left, right = layout.co_partition(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
    return left.join(right, "c_custkey").groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(*)::BIGINT AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_plain(t: Tables) -> DataFrame:
    """The same, left to the planner."""
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_custkey").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast_inner(t: Tables) -> DataFrame:
    nations = t.nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lookup_join(t.supplier.select("s_suppkey", "s_nationkey"), nations, "s_nationkey", "inner").select("s_suppkey", "n_name")


@query("SELECT doc_id, source, n_chars / total AS share FROM (SELECT doc_id, source, n_chars::DOUBLE AS n_chars, sum(n_chars) OVER (PARTITION BY source) AS total FROM documents) WHERE source IS NOT NULL")
def join_skewed(t: Tables) -> DataFrame:
    """Each document's share of its source. Sources of more than an eighth of the documents are salted, and only their totals repeated."""
    docs = t.documents.select("doc_id", "source", F.col("n_chars").cast("double").alias("n_chars"))
    totals = docs.groupBy("source").agg(F.sum("n_chars").alias("total"))
    rows = max(1, t.documents.count() // 8)  # parquet footers give the number
    joined = layout.skew_join(docs, totals, "source", rows=rows, row_id=F.col("doc_id"))
    return joined.select("doc_id", "source", (F.col("n_chars") / F.col("total")).alias("share"))


@query("SELECT o_orderkey, o_custkey, count(*)::BIGINT AS lines, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey")
def join_bucketed(t: Tables) -> DataFrame:
    """Both tables saved in buckets of the order's key: the join and the aggregate by it read them without any exchange."""
    buckets = layout.session_parts(t.spark)
    orders = layout.bucketed(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", buckets)
    lines = layout.bucketed(t.lineitem.select("l_orderkey", "l_quantity"), "l_orderkey", buckets)
    joined = orders.hint("merge").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_custkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))
