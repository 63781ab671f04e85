"""Parquet laid out so that point and set lookups read few rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkloom.operators.layout import session_parts

#: Bytes of a row group, and rows of a page, within which a lookup reads all or nothing.
GROUP_BYTES, PAGE_ROWS = 8 << 20, 4096


def write_skippable(df: DataFrame, path: str, sort: str, blooms: Sequence[str] = (), distinct: int = 1_000_000, group_bytes: int = GROUP_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """df in files of separate ranges of `sort`, sorted inside, with Bloom filters on the columns of `blooms`.

    Filters on `sort` skip files, row groups and pages by their least and greatest values; equality and IN on a Bloom
    column skip the row groups whose filter holds none of the values, wherever they stand. `distinct` is the
    number of values of a Bloom column to expect in a row group.
    """
    writer = df.repartitionByRange(session_parts(df.sparkSession), sort).sortWithinPartitions(sort).write.mode("overwrite")
    writer = writer.option("parquet.block.size", group_bytes).option("parquet.page.row.count.limit", page_rows).option("parquet.block.size.row.check.min", 100)
    for name in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{name}", "true").option(f"parquet.bloom.filter.expected.ndv#{name}", distinct)
    writer.parquet(path)


def scanned_rows(df: DataFrame) -> int:
    """Rows that the scans of a plan have given when it ran: collects df, then reads the scans' counters."""
    execution = df._jdf.queryExecution()
    execution.executedPlan().executeCollect()
    plan, total, todo = execution.executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
    return total
