"""Profile of all columns of a table in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame) -> DataFrame:
    """``column, count, unique, top, freq`` per column: rows, distinct values
    that are not null, the most frequent of them (ties: the smallest, as text)
    and how often it occurs.

    The columns are turned into (column, value) rows by ``unpivot`` in the scan
    itself and counted on two levels: (column, value) first, in the map tasks
    too, so a value of very many rows is one row a task when it is shuffled.
    Values are compared as text.  A table without rows gives none.
    """
    names = df.columns
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot([], names, "column", "value")
    per_value = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    top = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), "value")))
    out = per_value.groupBy("column").agg(F.sum("n").alias("count"), F.count("value").alias("unique"), top.alias("_top"))
    return out.select("column", "count", "unique", F.col("_top.value").alias("top"), (-F.col("_top.m")).alias("freq"))
