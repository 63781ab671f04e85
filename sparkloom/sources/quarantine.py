"""CSV intake that loses no line: rows that don't fit the schema go to a quarantine, as they were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.layout import written

RAW = "_raw"


def read_checked(spark: SparkSession, path: str, schema: str, header: bool = False, multiline: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows of the schema, and (raw, reason) of lines that aren't.

    Files are parsed once; what that gives is written to the shared folder, and both tables read that. A line is bad if
    it has fewer or more fields than the schema ("short", "long") or a value that isn't of its column's
    type ("type"). An empty value is null and good. Quoted values may hold commas, doubled quotes and, with
    multiline, line ends; then a file is one task's work, else files are split.
    """
    columns = T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)
    if RAW in columns.names:
        raise ValueError(f"a column named {RAW} can't be told from the raw line")
    reader = spark.read.schema(f"{schema}, {RAW} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW)
    parsed = written(reader.option("header", header).option("multiLine", multiline).option("escape", '"').csv(path), "parsed-csv")
    good = parsed.where(F.col(RAW).isNull()).drop(RAW)
    n = len(columns)
    fields = F.from_csv(F.col(RAW), F.lit(", ".join(f"f{k} string" for k in range(n + 1))), {"escape": '"', "multiLine": "true", "emptyValue": "", "nullValue": "\u0001"})
    reason = F.when(fields[f"f{n}"].isNotNull(), "long").when(fields[f"f{n - 1}"].isNull(), "short").otherwise("type")
    return good, parsed.where(F.col(RAW).isNotNull()).select(F.col(RAW).alias("raw"), reason.alias("reason"))
