"""Generators and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.exprs import count_up, letters, words
from sparkloom.plans.registry import query
from sparkloom.sources.tables import Tables


@query("SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w")
def word_count(t: Tables) -> DataFrame:
    """The words of all lines, whatever their language."""
    return _counted(t.documents)


@query("SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents WHERE lang = 'en') WHERE w <> '' GROUP BY w ORDER BY n DESC, w")
def word_count_of_a_language(t: Tables) -> DataFrame:
    """The filter is the feature: the words of English documents."""
    return _counted(t.documents.where(F.col("lang") == "en"))


@query("SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM documents) WHERE w <> '' GROUP BY w ORDER BY n DESC, w")
def word_count_all(t: Tables) -> DataFrame:
    """The words of all lines, whatever their language."""
    return _counted(t.documents)


def _counted(docs: DataFrame) -> DataFrame:
    each = docs.select(F.explode(words(F.lower("text"))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word")


@query(
    "SELECT count(*)::BIGINT AS tokens, count(*) FILTER (WHERE w = '')::BIGINT AS empty FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)"
)
def split_words(t: Tables) -> DataFrame:
    """Split at each single space: runs of spaces give empty words."""
    each = t.documents.select(F.explode(F.split("text", " ")).alias("w"))
    return each.agg(F.count("*").alias("tokens"), F.count_if(F.col("w") == "").alias("empty"))


@query("SELECT o_orderkey, o_custkey, unnest(string_split(parts, ';')) AS product FROM (SELECT o_orderkey, o_custkey, 'P' || (o_orderkey % 7) || ';P' || (o_orderkey % 11) AS parts FROM orders)")
def explode_products(t: Tables) -> DataFrame:
    parts = F.concat(F.lit("P"), (F.col("o_orderkey") % 7).cast("string"), F.lit(";P"), (F.col("o_orderkey") % 11).cast("string"))
    return t.orders.select("o_orderkey", "o_custkey", F.explode(F.split(parts, ";")).alias("product"))


@query("SELECT n_nationkey, unnest(range(n_nationkey)) AS i FROM nation")
def range_explode(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.explode(count_up(F.col("n_nationkey"))).alias("i"))


@query("SELECT string_agg(c, '' ORDER BY c) AS chars FROM (SELECT DISTINCT c FROM (SELECT unnest(string_split(n_name, '')) AS c FROM nation) WHERE c <> '')")
def unique_chars(t: Tables) -> DataFrame:
    each = t.nation.select(F.explode(letters(F.col("n_name"))).alias("c"))
    return each.agg(F.array_join(F.array_sort(F.collect_set("c")), "").alias("chars"))


@query("SELECT DISTINCT d AS domain FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+)', 1)) AS d FROM documents)")
def email_domains(t: Tables) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@([A-Za-z0-9.-]+)"), F.lit(1))
    return t.documents.where(F.contains("text", F.lit("@"))).select(F.explode(found).alias("domain")).distinct()


@query("SELECT string_agg(d, '' ORDER BY d) AS digits FROM (SELECT DISTINCT d FROM (SELECT unnest(regexp_extract_all(text, '[0-9]', 0)) AS d FROM documents))")
def unique_digits(t: Tables) -> DataFrame:
    each = t.documents.where(F.col("text").rlike("[0-9]")).select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]"), F.lit(0))).alias("d"))
    return each.agg(F.array_join(F.array_sort(F.collect_set("d")), "").alias("digits"))


@query("SELECT n_regionkey, unnest(list_concat([n_nationkey], [n_nationkey * 2, n_nationkey * 3]))::BIGINT AS v FROM nation")
def flatten_lists(t: Tables) -> DataFrame:
    key = F.col("n_nationkey").cast("long")
    nested = F.array(F.array(key), F.array(key * 2, key * 3))
    return t.nation.select("n_regionkey", F.explode(F.flatten(nested)).alias("v"))
