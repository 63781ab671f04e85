"""Salting and explicit placement: results equal the plain query's, whatever the layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import bands, initial_index
from sparkloom.operators import layout
from sparkloom.operators.relational import global_position
from sparkloom.plans.registry import query
from sparkloom.sources.files import local_rows, skewed_keys
from sparkloom.sources.tables import Tables

_BY_LANG = "SELECT lang, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang"
#: The segments' places, others go to the last.
SEGMENTS = ("AUTOMOBILE", "BUILDING")


@query(_BY_LANG)
def salted_sum(t: Tables) -> DataFrame:
    return layout.salted_sum(t.documents, "lang", "n_chars", F.col("doc_id"))


@query(_BY_LANG)
def salted_hot_only(t: Tables) -> DataFrame:
    """Only keys with over a quarter of the rows are salted (at most three keys can be)."""
    rows = layout.marked_hot(t.documents.select("doc_id", "lang", "n_chars"), "lang")
    return layout.salted_sum(rows, "lang", "n_chars", F.col("doc_id"), salts=16, hot=F.col("hot"))


@query(_BY_LANG)
def hot_cold_union(t: Tables) -> DataFrame:
    """Hot keys salted, cold ones (a null key with them) summed plainly, both together."""
    rows = layout.marked_hot(t.documents.select("doc_id", "lang", "n_chars"), "lang")
    warm = layout.salted_sum(rows.where("hot"), "lang", "n_chars", F.col("doc_id"))
    cold = rows.where("NOT hot").groupBy("lang").agg(F.sum("n_chars").alias("total"))
    return warm.unionByName(cold)


@query(
    "SELECT CASE WHEN i < floor(n * 0.8) THEN 'popular' ELSE 'rare_' || ((i - floor(n * 0.8)::BIGINT) % 20) END AS key, sum(i)::BIGINT AS total FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM orders)) GROUP BY ALL"
)
def skewed_generator(t: Tables) -> DataFrame:
    """As many pairs as there are orders, of which four fifths have one key, summed with salts."""
    return layout.salted_sum(skewed_keys(t.spark, t.orders.count()), "key", "value", F.col("value"))


@query("SELECT salts, lang, sum(n_chars)::BIGINT AS total FROM documents, (VALUES (4), (8), (16)) s(salts) GROUP BY ALL")
def salts_compared(t: Tables) -> DataFrame:
    """The salted sum with 4, 8 and 16 salts on the hot keys only."""
    rows = layout.marked_hot(t.documents.select("doc_id", "lang", "n_chars"), "lang")
    each = [layout.salted_sum(rows, "lang", "n_chars", F.col("doc_id"), n, F.col("hot")).select(F.lit(n).alias("salts"), "lang", "total") for n in (4, 8, 16)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    "SELECT CASE WHEN i < floor(n * 0.9) THEN 'hot' ELSE 'key_' || ((i - floor(n * 0.9)::BIGINT) % 100) END AS key, count(*)::BIGINT AS n FROM (SELECT unnest(range(n)) AS i, n FROM (SELECT count(*) AS n FROM lineitem)) GROUP BY ALL"
)
def hot_generator(t: Tables) -> DataFrame:
    """As many pairs as there are lines of orders, of which nine tenths have one key, the rest a hundred."""
    return skewed_keys(t.spark, t.lineitem.count(), 0.9, 100, "hot", "key_").groupBy("key").agg(F.count("*").alias("n"))


@query("SELECT ((dense_rank() OVER (ORDER BY n_name) - 1) % 4)::INT AS part, n_name FROM nation")
def partition_by_sorted_index(t: Tables) -> DataFrame:
    """Keys dealt by their place among the sorted distinct keys, modulo four."""
    places = global_position(t.nation.select(F.col("n_name").alias("key")).distinct(), ["key"], "place")
    known = t.nation.select("n_name").join(places, F.col("n_name") == F.col("key"))
    return layout.place(known.select("n_name", "place"), 4, F.col("place")).select(F.spark_partition_id().alias("part"), "n_name")


@query("SELECT step, least(parts, (SELECT count(*) FROM orders))::INT AS parts FROM (VALUES ('grown', 12), ('merged', 3), ('repartitioned', 6)) v(step, parts)")
def partition_counts(t: Tables) -> DataFrame:
    """Partitions that hold rows after growing, merging neighbours and dealing anew."""
    rows = t.orders.select("o_orderkey")
    grown = layout.resized(rows, 12, grow=True)
    steps = {"grown": grown, "merged": layout.resized(grown, 3), "repartitioned": layout.resized(rows, 6, grow=True)}
    each = [df.select(F.lit(k).alias("step"), F.spark_partition_id().alias("p")).groupBy("step").agg(F.countDistinct("p").cast("int").alias("parts")) for k, df in steps.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("SELECT level, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders, (VALUES ('disk'), ('memory'), ('memory_and_disk')) v(level) GROUP BY level")
def persist_levels(t: Tables) -> DataFrame:
    """Aggregates over a table kept at each storage level, which is given back before the result is."""
    out = []
    for level, kept in (("disk", {"memory": False}), ("memory", {"disk": False}), ("memory_and_disk", {})):
        rows = layout.persisted(t.orders.select(F.col("o_totalprice").alias("v")), **kept)
        n, total = rows.agg(F.count("*"), F.round(F.sum("v"), 2)).first()
        rows.unpersist()
        out.append((level, n, total))
    return local_rows(t.spark, out, "level string, n long, total double")


@query("SELECT (c_nationkey % 4)::INT AS part, c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def partition_by_nation(t: Tables) -> DataFrame:
    return layout.placed_counts(layout.place(t.customer, 4, F.col("c_nationkey")), "c_nationkey")


@query("SELECT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END AS part, c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def partition_by_segment(t: Tables) -> DataFrame:
    part = F.when(F.col("c_mktsegment") == SEGMENTS[0], 0).when(F.col("c_mktsegment") == SEGMENTS[1], 1).otherwise(2)
    return layout.placed_counts(layout.place(t.customer, 3, part), "c_mktsegment")


@query("SELECT CASE WHEN c_custkey BETWEEN 0 AND 24 THEN 0 WHEN c_custkey BETWEEN 25 AND 49 THEN 1 WHEN c_custkey BETWEEN 50 AND 74 THEN 2 WHEN c_custkey >= 75 THEN 3 ELSE 0 END AS part, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def partition_by_range(t: Tables) -> DataFrame:
    return layout.placed_counts(layout.place(t.customer, 4, bands(F.col("c_custkey"), (25, 50, 75))))


@query("SELECT (CASE WHEN ascii(upper(substr(p_name, 1, 1))) BETWEEN 65 AND 90 THEN ascii(upper(substr(p_name, 1, 1))) - 65 ELSE 0 END % 4)::INT AS part, count(*)::BIGINT AS n FROM part GROUP BY ALL")
def partition_by_initial(t: Tables) -> DataFrame:
    return layout.placed_counts(layout.place(t.part, 4, initial_index(F.col("p_name"))))


@query("SELECT CASE WHEN o_totalprice >= 375000 THEN 3 WHEN o_totalprice >= 250000 THEN 2 WHEN o_totalprice >= 125000 THEN 1 ELSE 0 END AS part, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def partition_by_amount(t: Tables) -> DataFrame:
    """Half-open bands, so no amount falls between two."""
    return layout.placed_counts(layout.place(t.orders, 4, bands(F.col("o_totalprice"), (125000, 250000, 375000))))


@query(
    "SELECT ((c_nationkey * 3 + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END) % 4)::INT AS part, c_nationkey, c_mktsegment, count(*)::BIGINT AS n FROM customer GROUP BY ALL"
)
def partition_composite(t: Tables) -> DataFrame:
    segment = F.when(F.col("c_mktsegment") == SEGMENTS[0], 0).when(F.col("c_mktsegment") == SEGMENTS[1], 1).otherwise(2)
    return layout.placed_counts(layout.place(t.customer, 4, F.col("c_nationkey") * 3 + segment), "c_nationkey", "c_mktsegment")


@query("SELECT (i % 8)::INT AS part, count(*)::BIGINT AS n FROM (SELECT o_orderkey AS i FROM orders) GROUP BY ALL")
def rows_per_partition(t: Tables) -> DataFrame:
    return layout.placed_counts(layout.place(t.orders.select("o_orderkey"), 8, F.col("o_orderkey")))
