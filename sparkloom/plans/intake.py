"""Intake and sinks that account for every row: quarantine, metrics of a write, files by partition, skipping layouts, what show() prints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.layout import place, shared_path
from sparkloom.plans.registry import query
from sparkloom.sources import files
from sparkloom.sources.quarantine import read_checked
from sparkloom.sources.sinks import default_parallelism, observed_write, shown, write_partitions
from sparkloom.sources.skipping import write_skippable
from sparkloom.sources.tables import Tables

_LAYOUT = "o_orderkey long, o_custkey long, o_totalprice double, note string"
_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_SQL_LINE = f"""CASE o_orderkey % 10
  WHEN 0 THEN concat(o_orderkey, ',', o_custkey)
  WHEN 1 THEN concat(o_orderkey, ',', o_custkey, ',', {_CENTS}, ',note,more')
  WHEN 2 THEN concat(o_orderkey, ',', o_custkey, ',n/a,note')
  WHEN 4 THEN concat(o_orderkey, ',x', o_custkey, ',', {_CENTS}, ',"two', chr(10), 'lines"') END"""


def order_lines(t: Tables) -> DataFrame:
    """Orders as CSV lines, by the key's last digit: 0 lacks fields, 1 has one more, 2 and 4 have values of other types; 3, 4 and 5 hold line ends, commas or quotes, 6 an empty note."""
    last = F.col("o_orderkey") % 10

    def line(*fields: Column | str) -> Column:
        return F.concat_ws(",", *(f.cast("string") if isinstance(f, Column) else F.lit(f) for f in fields))

    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.round(F.col("o_totalprice") * 100).cast("long")
    text = (
        F.when(last == 0, line(k, c)).when(last == 1, line(k, c, p, "note", "more")).when(last == 2, line(k, c, "n/a", "note")).when(last == 3, line(k, c, p, '"first\nsecond, ""third"""'))
        .when(last == 4, line(k, F.concat(F.lit("x"), c.cast("string")), p, '"two\nlines"')).when(last == 5, line(k, c, p, '"a, b"')).when(last == 6, line(k, c, p, "")).otherwise(line(k, c, p, "note"))
    )
    return t.orders.select(text.alias("value"))


def checked_orders(t: Tables) -> tuple[DataFrame, DataFrame]:
    path = shared_path(t.spark, "order-lines")
    order_lines(t).write.text(path)
    return read_checked(t.spark, path, _LAYOUT)


@query(
    f"SELECT o_orderkey, o_custkey, {_CENTS}::DOUBLE AS o_totalprice, CASE o_orderkey % 10 WHEN 3 THEN concat('first', chr(10), 'second, \"third\"') WHEN 5 THEN 'a, b' WHEN 6 THEN NULL ELSE 'note' END AS note "
    "FROM orders WHERE o_orderkey % 10 NOT IN (0, 1, 2, 4)"
)
def csv_good_rows(t: Tables) -> DataFrame:
    """Lines that fit the schema, typed."""
    return checked_orders(t)[0]


@query(f"SELECT {_SQL_LINE} AS raw, CASE o_orderkey % 10 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'type' END AS reason FROM orders WHERE o_orderkey % 10 IN (0, 1, 2, 4)")
def csv_quarantine(t: Tables) -> DataFrame:
    """Lines that don't, as they were written, and why."""
    return checked_orders(t)[1]


@query(f"SELECT place, count(*)::BIGINT AS n, sum({_CENTS})::BIGINT AS cents, max(o_orderkey) AS last FROM orders, (VALUES ('observed'), ('read back')) p(place) GROUP BY place")
def observed_orders(t: Tables) -> DataFrame:
    """Count, sum and greatest key taken while orders are written, next to those of the table read back."""
    path = shared_path(t.spark, "observed")
    metrics = {"n": F.count(F.lit(1)), "cents": F.sum(F.round(F.col("o_totalprice") * 100).cast("long")), "last": F.max("o_orderkey")}
    seen = observed_write(t.orders.select("o_orderkey", "o_totalprice"), path, **metrics)
    back = t.spark.read.parquet(path).agg(*(c.alias(n) for n, c in metrics.items())).select(F.lit("read back").alias("place"), *metrics)
    return files.local_rows(t.spark, [("observed", *(seen[n] for n in metrics))], "place string, n long, cents long, last long").unionByName(back)


@query("SELECT (c_nationkey % 4)::INT AS part, c_nationkey, count(*)::BIGINT AS n FROM customer GROUP BY ALL")
def partition_files(t: Tables) -> DataFrame:
    """Customers dealt to four partitions, each of which wrote a file of its own; read back with the file's number."""
    path = shared_path(t.spark, "partition-files")
    write_partitions(place(t.customer.select("c_custkey", "c_nationkey"), 4, F.col("c_nationkey")), path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    return files.read_csv(t.spark, path, "c_custkey long, c_nationkey int, part int").groupBy(part.alias("part"), "c_nationkey").agg(F.count("*").alias("n"))


def skippable_orders(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "skippable")
    write_skippable(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, "o_orderkey", ["o_custkey"], distinct=4096, group_bytes=64 << 10, page_rows=1000)
    return t.spark.read.parquet(path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (3, 1000, 14000) OR o_orderkey BETWEEN 700 AND 720")
def lookup_sorted(t: Tables) -> DataFrame:
    """Point and range lookups by the sorted column: files, row groups and pages are skipped by their bounds."""
    key = F.col("o_orderkey")
    return skippable_orders(t).where(key.isin(3, 1000, 14000) | key.between(700, 720))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (5, 77)")
def lookup_bloom(t: Tables) -> DataFrame:
    """A set lookup by a column whose values stand everywhere: row groups are skipped by their Bloom filters."""
    return skippable_orders(t).where(F.col("o_custkey").isin(5, 77))


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 5")
def first_customers(t: Tables) -> DataFrame:
    """The first rows of an order, taken to the driver: k rows of each task, whatever the table's size."""
    rows = files.first_rows(t.customer.select("c_custkey", "c_name"), 5, F.desc("c_custkey"))
    return files.local_rows(t.spark, [tuple(r) for r in rows], "c_custkey long, c_name string")


@query(
    "SELECT 'plain' AS form, n, line FROM (SELECT row_number() OVER (ORDER BY o) - 1 AS n, line FROM (SELECT 0 AS o, '+-----------+-----------+' AS line UNION ALL SELECT 1, '|r_regionkey|r_name     |' UNION ALL SELECT 2, '+-----------+-----------+' "
    "UNION ALL SELECT 3 + r_regionkey, concat('|', rpad(r_regionkey::VARCHAR, 11, ' '), '|', rpad(r_name, 11, ' '), '|') FROM region UNION ALL SELECT 99, '+-----------+-----------+')) "
    "UNION ALL SELECT 'cut', r_regionkey, concat(' r_name | ', CASE WHEN length(r_name) > 5 THEN concat(left(r_name, 2), '...') ELSE r_name END, repeat(' ', greatest(0, 5 - length(r_name)))) FROM region"
)
def shown_regions(t: Tables) -> DataFrame:
    """What show() prints: whole values in a table, and cut ones a row at a time (of those, the names' lines)."""
    regions = t.region.select("r_regionkey", F.rpad("r_name", F.lit(11), F.lit(" ")).alias("r_name")).orderBy("r_regionkey")
    plain = [line for line in shown(regions, truncate=False) if line]
    cut = [line for line in shown(t.region.select("r_name", "r_regionkey").orderBy("r_regionkey"), truncate=5, vertical=True) if line.startswith(" r_name")]
    rows = [("plain", n, line) for n, line in enumerate(plain)] + [("cut", n, f" r_name | {line.split('|')[1].strip():<5}") for n, line in enumerate(cut)]
    return files.local_rows(t.spark, rows, "form string, n long, line string")


@query(None)
def parallelism(t: Tables) -> DataFrame:
    """The session's default parallelism, next to the partitions that a scan of orders is read in."""
    return t.orders.select(F.spark_partition_id().alias("p")).agg(F.countDistinct("p").alias("scan_parts")).withColumn("default_parts", F.lit(default_parallelism(t.spark)))
