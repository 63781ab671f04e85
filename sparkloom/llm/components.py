"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, release, spread_join


def _minima(pairs: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours, next to every pair.

    A min, which combines map-side, and a join that deals the pairs of one node
    over many tasks: a component may hold a third of all nodes. The plan holds
    pairs twice, so what is built on this should name its own input once.
    """
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("m"))
    return spread_join(pairs, low, "u").select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
    return _minima(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    ends = F.array("u", F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")))
    return _minima(edges).select(F.explode(ends).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b), root being the smallest node it reaches.

    Ends after a number of rounds that grows with the logarithm of the edges;
    each round is written to the shared folder, the one before deleted, and only
    counts reach the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialise(pairs, "edges")
    before = None
    while True:
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before, old = now, state
        state = materialise(_small(_large(state).distinct()), "stars")
        release(old)
