"""Joins, top-k, ranks and aggregates that need more than one DataFrame call."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.layout import session_parts, written

#: Bytes of optimizer-estimated size up to which lookup_join broadcasts the dimension.
BROADCAST_BYTES = 8 << 20


def top_k(df: DataFrame, k: int, *order: Column | str) -> DataFrame:
    """First k rows of a total order: each task keeps k rows (TakeOrderedAndProject), nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def lookup_join(facts: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join a dimension; it is broadcast if its estimated size is below BROADCAST_BYTES, else the planner decides."""
    small = estimated_bytes(dimension) <= BROADCAST_BYTES
    return facts.join(F.broadcast(dimension) if small else dimension, on, how)


def match_kind(left: Column, right: Column) -> Column:
    """Which sides a full outer join found, given a never-null column of either."""
    return F.when(left.isNull(), "right_only").when(right.isNull(), "left_only").otherwise("both")


def number_stats(value: str | Column) -> list[Column]:
    """Sum, count, mean, min, max, population deviation and variance: one pass, stable formulas."""
    value = F.col(value) if isinstance(value, str) else value
    return [
        F.round(F.sum(value), 2).alias("total"),
        F.count(value).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.min(value).alias("lowest"),
        F.max(value).alias("highest"),
        F.round(F.stddev_pop(value), 3).alias("deviation"),
    ]


#: Size parameter of the quantile sketch (its bytes don't depend on the rows), and how far from a rank its answers may lie.
SKETCH_K, SKETCH_ERROR = 2048, 0.004
#: Pieces that a bracket is cut into, so that what is counted in it is ranked in several tasks.
PIECES = 8


def region(value: Column, points: Sequence[float]) -> Column:
    """How many of the ascending points a double reaches: a tree of comparisons, as deep as their number's logarithm."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < F.lit(points[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(points))


def floor_percentiles(df: DataFrame, value: str, shares: Sequence[float], k: int = SKETCH_K, error: float = SKETCH_ERROR) -> DataFrame:
    """(share, value): for each share p the element at zero-based place floor(n * p), no interpolation; exact.

    Two reads of the table. The first makes one mergeable sketch of the finite values, in a task each and
    then together, and counts the others; its quantiles at a little less and more than a share's rank
    bracket the element. The second counts rows by their range: between brackets only how many, inside them
    by value. The ranges' sums say in which of them a place lies, and only there values are ranked. A
    sketch is right but for a small chance: if the counts show that a bracket missed its place, which
    shows in its range not being one of single values, that bracket is doubled and read again, in the end to all values.

    Order is Spark's: -inf first, then finite values, inf, NaN; nulls don't count. No values, no rows.
    """
    number = F.col(value).cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)
    whole, low, sketch = df.agg(F.count(value), F.count_if(number == F.lit(float("-inf"))), F.kll_sketch_agg_double(finite, F.lit(k))).first()
    kind = df.schema[value].dataType.simpleString()
    if not whole:
        return df.select(F.lit(0.0).alias("share"), F.col(value)).limit(0)
    places = {float(p): min(int(whole * p), whole - 1) for p in shares}
    spark, found = df.sparkSession, {}
    while missing := [p for p in places if p not in found]:
        brackets, points, closed = [], [], error >= 1
        n = _sketched(spark, sketch, "n") if sketch is not None else 0
        if n and not closed:
            ranks = [min(1.0, max(0.0, (places[p] - low) / n + d * error)) for p in missing for d in [-1 + 2 * j / PIECES for j in range(PIECES + 1)]]
            cuts = _sketched(spark, sketch, ranks)
            for j, p in enumerate(missing):
                mine, r = sorted(cuts[j * (PIECES + 1) : (j + 1) * (PIECES + 1)]), (places[p] - low) / n
                first, last = (float("-inf") if r - error <= 0 else mine[0]), (float("inf") if r + error >= 1 else math.nextafter(mine[-1], math.inf))
                brackets.append((first, last))
                points += [c for c in (first, *mine, last) if math.isfinite(c)]
        points = sorted(set(points))
        edges = [float("-inf"), *points]
        single = [closed or any(a <= e < b for a, b in brackets) for e in edges]
        ranged = df.where(F.col(value).isNotNull()).select(F.col(value).alias("x"), region(number, points).alias("range"))
        # what isn't finite is few values, which stand in the outermost ranges
        keep = F.col("x").cast("double")
        inside = F.element_at(F.array(*map(F.lit, single)), F.col("range") + 1) | F.isnan(keep) | (F.abs(keep) == F.lit(float("inf")))
        counts = ranged.withColumn("x", F.when(inside, F.col("x"))).groupBy("range", "x").agg(F.count("*").alias("rows"))
        # in the first range single values come before the rest only if they are -inf, in the last only after it
        part = F.struct(F.col("range"), F.when(F.col("x").isNull(), 1).when(F.col("x").cast("double") == F.lit(float("-inf")), 0).otherwise(2).alias("step"))
        counts = counts.select(part.alias("part"), "x", "rows")
        sums = counts.groupBy("part").agg(F.sum("rows").alias("n"))  # at most three rows of a range
        before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.select(F.col("part").alias("at"), before.alias("before"), "n")
        wanted = spark.createDataFrame([(p, places[p]) for p in missing], "share double, place long")
        sought = sums.join(F.broadcast(wanted), (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
        held = counts.join(F.broadcast(sought), F.col("part") == F.col("at"))
        upto = F.col("before") + F.sum("rows").over(Window.partitionBy("share").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
        ranked = held.withColumn("stop", upto).where((F.col("place") < F.col("stop")) & (F.col("place") >= F.col("stop") - F.col("rows")))
        found |= {r["share"]: r["x"] for r in ranked.where("x IS NOT NULL").select("share", "x").collect()}
        error = error * 2 if error < 0.25 else 1.0
    return spark.createDataFrame(sorted(found.items()), f"share double, {value} {kind}")


def _sketched(spark: SparkSession, sketch: bytes, what: str | list[float]) -> int | list[float]:
    """The number of values a sketch has seen, or its quantiles at ranks, as they are found on the driver."""
    row = spark.range(1).select(F.lit(bytes(sketch)).alias("s"))
    if what == "n":
        return row.select(F.kll_sketch_get_n_double("s")).first()[0]
    return list(row.select(F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, what)))).first()[0])


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, changed where df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def prefix_sums(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column], partitions: int | None = None, inclusive: bool = True) -> DataFrame:
    """df with running sums of columns in a total order, without gathering all rows in one task.

    Rows are dealt by range of the whole order, so that a value of its first column that a
    third of the rows have is dealt too, and written to the shared folder, which fixes the deal
    whatever is computed again. Each part's totals, one row a part, give what stands before it; the running
    sums inside a part are added to that. Nulls count as 0. What is written goes
    when the driver's JVM ends, or with layout.forget().
    """
    part, *rest = _names(df, "part_", *(f"before_{n}" for n in range(len(sums))), *(f"value_{n}" for n in range(len(sums))))
    before, value = rest[: len(sums)], rest[len(sums) :]
    given = df.select("*", *(F.coalesce(c, F.lit(0)).alias(v) for c, v in zip(sums.values(), value)))
    partitions = partitions or session_parts(df.sparkSession)
    dealt = written(given.repartitionByRange(partitions, *order).withColumn(part, F.spark_partition_id()), "prefix-sums")
    totals = dealt.groupBy(part).agg(*(F.sum(v).alias(v) for v in value))
    above = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(part, *(F.coalesce(F.sum(v).over(above), F.lit(0)).alias(b) for v, b in zip(value, before)))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(offsets), part)  # one row a part
    own = [F.sum(v).over(inside) if inclusive else F.sum(v).over(inside) - F.col(v) for v in value]
    result = joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in sums), *((F.col(b) + o).alias(name) for name, b, o in zip(sums, before, own)))
    result.written_path = dealt.written_path
    return result


def global_position(df: DataFrame, order: Sequence[str | Column], name: str = "position", partitions: int | None = None) -> DataFrame:
    """Zero-based place of each row in a total order: the prefix sum of ones before it."""
    return prefix_sums(df, order, {name: F.lit(1).cast("long")}, partitions, inclusive=False)
