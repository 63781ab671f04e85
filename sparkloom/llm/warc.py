"""Not-modified revisits of web captures, resolved by an as-of join.

A revisit record (a 304 answer) has no payload. It stands for the latest full
response to the same canonical URL before it, if a validator agrees: equal entity
tags (weak comparison), else equal Last-Modified. The resolved record takes the
response's payload and headers, replaced by those headers that a 304 may update.

The as-of join is a prefix scan. Records are dealt by range of their whole order (URL,
time, kind, id) into parts of about PART_RECORDS, so a URL with a third of all
records, or a time with most of them, is dealt over many parts, whatever the size of
the table; the deal is written to the shared folder, which fixes it. Inside a part the
last response stands before a revisit in a window. What a part's first URL had in the parts before
is carried over: one row a part at most. Payloads don't move: the join handles record ids.

Defined results: outcome is `full` for responses, `resolved`, `changed` (the
validators differ or are missing) or `orphan` (no earlier response). Earlier means
a smaller time; of responses at one time the largest record id counts, of equal
ids the largest hash of headers, so repeated rows and ties have one result each; a
record without a time is never found, and as a revisit is an orphan; a null or
empty URL is canonically empty and such records refer to each other as any others;
very long URLs and header values are kept whole; null headers are none; an empty
table gives an empty result; other columns are kept whatever their names, and
those named like a result column replaced. Rows that are equal in the whole order lie in one part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.layout import session_parts

from .shared import materialise, packed, unpacked

#: Records that a part holds, about; a session has as many parts as shuffle partitions at least.
PART_RECORDS = 200_000
#: Headers that a 304 answer may update (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that name a campaign, not a page.
TRACKING = r"^(?:utm_[a-z]+|fbclid|gclid|ref)(?:=|$)"
OUT = ("canonical", "outcome", "refers_to", "payload_of", "merged")


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without a slash at the end, sorted query without tracking; no scheme, no fragment."""
    plain = F.regexp_replace(F.regexp_replace(F.coalesce(F.trim(url), F.lit("")), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(plain, r"^([^/?]*)", 1)), r":(?:80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def strong(etag: Column) -> Column:
    """An entity tag without its mark of weakness."""
    return F.regexp_replace(etag, r"^W/", "")


def dealt(records: DataFrame, parts: int | None = None) -> DataFrame:
    """(row, canonical, part) of records, dealt by range of canonical URL, time, kind, id and headers; written and read back."""
    spark = records.sparkSession
    parts = parts or max(session_parts(spark), -(-records.count() // PART_RECORDS))
    rows = records.select(packed(records), canonical_url(F.col("url")).alias("canonical"))
    return materialise(rows.repartitionByRange(parts, "canonical", *in_order()).withColumn("part", F.spark_partition_id()), "captures")


def in_order() -> list[Column]:
    """The order of one URL's records; at one time revisits come first, as earlier means a smaller time."""
    row = F.col("row")
    answers = F.when(row["kind"] == "response", 1).otherwise(0)
    return [row["ts"], answers, row["record_id"], F.xxhash64(F.array_sort(F.map_entries(headers_of(row))))]


def headers_of(row: Column) -> Column:
    return F.coalesce(row["headers"], F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, parts: int | None = None) -> DataFrame:
    """Records with canonical, outcome, refers_to, payload_of and merged headers.

    records: record_id long, url string, ts long, kind ('response' or 'revisit'),
    headers map<string,string> with names in lower case. payload_of is the
    record that holds the payload (null if there is none).
    """
    row = F.col("row")
    full = F.when((row["kind"] == "response") & row["ts"].isNotNull(), F.struct(row["record_id"].alias("id"), headers_of(row).alias("headers")))
    rows = dealt(records, parts).withColumn("full", full)
    last = rows.groupBy("canonical", "part").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct(*in_order()))).alias("last"))
    past = Window.partitionBy("canonical").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(F.col("canonical").alias("c"), F.col("part").alias("p"), F.last("last", ignorenulls=True).over(past).alias("carried")).where("carried IS NOT NULL")
    inside = Window.partitionBy("canonical", "part").orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, (F.col("canonical") == F.col("c")) & (F.col("part") == F.col("p")), "left").withColumn("inner", F.last("full", ignorenulls=True).over(inside))
    joined = joined.select("*", *(row[c].alias(c) for c in ("record_id", "ts", "kind")), headers_of(row).alias("headers"))
    found = joined.withColumn("found", F.when((F.col("kind") == "revisit") & F.col("ts").isNotNull(), F.coalesce("inner", "carried")))
    own, theirs = F.col("headers"), F.col("found.headers")
    tags = (F.try_element_at(own, F.lit("etag")), F.try_element_at(theirs, F.lit("etag")))
    times = (F.try_element_at(own, F.lit("last-modified")), F.try_element_at(theirs, F.lit("last-modified")))
    agrees = F.when(tags[0].isNotNull() & tags[1].isNotNull(), strong(tags[0]) == strong(tags[1])).otherwise(F.coalesce(times[0] == times[1], F.lit(False)))
    outcome = F.when(F.col("kind") == "response", "full").when(F.col("found").isNull(), "orphan").when(agrees, "resolved").otherwise("changed")
    update = F.map_filter(own, lambda k, _: k.isin(*PERMITTED))
    kept = F.map_filter(theirs, lambda k, _: ~F.array_contains(F.map_keys(update), k))
    judged = found.withColumn("outcome", outcome)
    refers = F.when(F.col("outcome") == "resolved", F.col("found.id"))
    return judged.select(
        *unpacked(records, *OUT), "canonical", "outcome", refers.alias("refers_to"), F.when(F.col("outcome") == "full", F.col("record_id")).otherwise(refers).alias("payload_of"),
        F.when(F.col("outcome") == "resolved", F.map_concat(kept, update)).otherwise(own).alias("merged"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Capture records of the pages table: a full response for each page, a revisit soon after, one much later.

    Between a page's response and its late revisit another page of the same
    canonical URL may have been fetched; the revisit's entity tag then disagrees.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    kind = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(k).alias("kind"), F.lit(t).alias("later")) for n, k, t in ((0, "response", 0), (1, "revisit", 5), (2, "revisit", 400_003))]))
    rows = pages.select("page_id", "url", tag.alias("tag"), F.length("html").alias("n"), kind.alias("r"))
    ts = (F.col("page_id") * 10 + F.col("r.later")).cast("long")
    full = F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.coalesce(F.col("n"), F.lit(0)).cast("string"), F.lit("date"), ts.cast("string"), F.lit("etag"), F.col("tag"))
    light = F.create_map(F.lit("date"), ts.cast("string"), F.lit("etag"), F.concat(F.lit("W/"), F.col("tag")), F.lit("content-length"), F.lit("0"))
    return rows.select(
        (F.col("page_id") * 3 + F.col("r.n")).cast("long").alias("record_id"), "url", ts.alias("ts"), F.col("r.kind").alias("kind"),
        F.when(F.col("r.kind") == "response", full).otherwise(light).alias("headers"),
    )


def report(resolved: DataFrame) -> DataFrame:
    """Resolved records with the merged headers as one sorted text."""
    lines = F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select("record_id", "canonical", "ts", "kind", "outcome", "refers_to", "payload_of", F.array_join(F.array_sort(lines), "\n").alias("merged"))


ORACLE_SQL = r"""
WITH captures AS (
  SELECT page_id * 3 + n AS record_id, url, page_id * 10 + later AS ts, kind, '"' || md5(coalesce(html, '')) || '"' AS tag, coalesce(length(html), 0) AS size
  FROM pages, (VALUES (0, 'response', 0), (1, 'revisit', 5), (2, 'revisit', 400003)) k(n, kind, later)
), plain AS (
  SELECT *, regexp_replace(regexp_replace(coalesce(trim(url), ''), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS p FROM captures
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(p, '^([^/?]*)', 1)), ':(?:80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(p, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(p, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|fbclid|gclid|ref)(?:=|$)'))) AS kept
  FROM plain
), named AS (
  SELECT record_id, ts, kind, tag, size, host || path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM parts
), placed AS (
  SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'tag': tag, 'size': size} END IGNORE NULLS) OVER (
      PARTITION BY canonical ORDER BY ts, CASE WHEN kind = 'response' THEN 1 ELSE 0 END, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS found
  FROM named
), judged AS (
  SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN found IS NULL THEN 'orphan' WHEN found.tag = tag THEN 'resolved' ELSE 'changed' END AS outcome FROM placed
)
SELECT record_id::BIGINT AS record_id, canonical, ts::BIGINT AS ts, kind, outcome,
  (CASE WHEN outcome = 'resolved' THEN found.id END)::BIGINT AS refers_to,
  (CASE WHEN outcome = 'full' THEN record_id WHEN outcome = 'resolved' THEN found.id END)::BIGINT AS payload_of,
  CASE outcome
    WHEN 'full' THEN 'content-length: ' || size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: ' || tag
    WHEN 'resolved' THEN 'content-length: ' || found.size || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/' || tag
    ELSE 'content-length: 0' || chr(10) || 'date: ' || ts || chr(10) || 'etag: W/' || tag END AS merged
FROM judged
"""
