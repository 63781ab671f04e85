"""Mix sources to target weights by repetition rates.

Sizes are aggregated per source, targets follow from the weights (no source
above `most` times its size; what is cut goes to the others by weight), and a
source's rate is its target over its size. A document is emitted floor(rate)
times, plus once more if a coin seeded by its id falls below the fraction.

Sources get their places from a range-dealt order and the water level from a few
sums over the sources, repeated until no further source is capped: however many
sources there are, no task holds them all, and only sums reach the driver.

Defined results: a null text has size 0, an empty one too, and of very long ones
every word counts; a null source is a source of its own, last in order; a source
of size 0 has target 0 and emits nothing; equal caps (ties) are capped alike; an
empty table gives an empty result. Rows that repeat an id share its coin; a null id
takes its coin from the text. Other columns are kept, whatever their names; one
that mix() returns by the same name is replaced, emit() replaces none but `copy`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.relational import global_position

from .shared import materialise, packed, unpacked

#: A word; the complement is ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
WEIGHTS = (5, 2, 1)
#: Copies of each source's row in the join, so that a hot source's documents don't meet in one task.
SALTS = 16
OUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Words of a text: each is shrunk to one letter, so nothing but a shorter string is built."""
    words = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(words, SPACES, "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, source_size).

    Water filling: the level is what is left for the sources that aren't capped,
    by their weights. It rises as sources whose cap it has reached are taken out,
    until it reaches no further cap; each step is one sum over the sources.
    """
    ranked = (
        global_position(sizes, [F.col("source").asc_nulls_last()], "place")
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.lit(most) * F.col("source_size"))
        .withColumn("cap_each", F.col("cap") / F.col("weight"))
    )
    ranked = materialise(ranked, "mix-sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        full = F.lit(False) if level is None else F.col("cap_each") <= F.lit(level)
        capped, left = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        now = (share * total - (capped or 0.0)) / left if left else float("inf")
        if now == level or not left:
            level = now
            break
        level = now
    target = F.least(F.col("cap"), F.col("weight") * F.lit(level))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def coin(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) from the id: the first 52 bits of an MD5."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"mix-{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _rated(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, whole: bool) -> DataFrame:
    """(row, size, source_size, target, copies, taken); row has the columns of docs, but text if not `whole`.

    The sizes per source are summed map-side, the targets (a row per source) are
    written out, and the planner broadcasts them only if the files are below its
    threshold; else the join shuffles on source and salt. A hot source is never
    gathered: its rows carry SALTS different keys. Without texts the rows are
    written once with their sizes, so that words are counted in one pass.
    """
    given = docs if whole else docs.drop("text")
    rows = docs.select(packed(given), F.col("source").alias("own"), word_count(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text"), seed).alias("u"))
    if not whole:
        rows = materialise(rows, "mix-sizes")
    sizes = rows.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, most), "mix-targets")
    salted = targets.select(F.col("source").alias("theirs"), "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # two keys that are never null stand for a null-safe comparison
    joined = rows.join(
        salted,
        (F.coalesce("own", F.lit("")) == F.coalesce("theirs", F.lit(""))) & (F.col("own").isNull() == F.col("theirs").isNull()) & (F.floor(F.col("u") * SALTS).cast("int") == F.col("salt")),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + F.when(F.col("u") < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumn("copies", copies).select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1, keep_text: bool = True) -> DataFrame:
    """Each row of docs with size, source_size, target, copies and taken."""
    rated = _rated(docs, weights, share, most, seed, keep_text)
    return rated.select(*unpacked(docs, *OUT, *(() if keep_text else ("text",))), *OUT)


def emit(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The rows of the mix: each row of docs as many times as its copies say, numbered from 1 in `copy`."""
    rows = _rated(docs, weights, share, most, seed, True).where(F.col("copies") > 0)
    return rows.select(*unpacked(docs, "copy"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sizes
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size AS cap FROM ranked
), levels AS (
  SELECT *, cap / weight AS cap_each,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed
  WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), water AS (
  SELECT first(level ORDER BY cap_each, place) FILTER (WHERE cap_each > level) AS level FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(cap, weight * water.level), cap)::DOUBLE AS target FROM levels, water
), coins AS (
  SELECT *, ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized
), rated AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, c.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM coins c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
