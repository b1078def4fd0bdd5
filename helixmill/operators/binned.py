"""Row order along chromosomes without a window over a whole chromosome.

Rows are dealt into bins of places. Windows span one bin; what a bin needs from those before it comes from one summary
row for each bin, and only these summaries meet in a window by chromosome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE = 1 << 16


def with_bin(rows: DataFrame, at: str, size: int = SIZE) -> DataFrame:
    return rows.withColumn("_bin", F.floor(F.col(at) / size).cast("long"))


def in_bin(*keys: str):
    return Window.partitionBy(*keys, "_bin")


def before_bins(*keys: str):
    """All bins before a summary's own."""
    return Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)


def joined(rows: DataFrame, summary: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of their bin's summary. Keys are equal even where they are null."""
    on = [rows[k].eqNullSafe(summary[k]) for k in (*keys, "_bin")]
    return rows.join(summary, on, "left").drop(*(summary[k] for k in (*keys, "_bin")))


def previous(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "_before", size: int = SIZE) -> DataFrame:
    """rows with ``name``: the value of the row before in its keys, null for the first; order begins with the place."""
    rows = with_bin(rows.withColumn("_value", value), order[0], size)
    last = rows.groupBy(*keys, "_bin").agg(F.max_by("_value", F.struct(*order)).alias("_last"))
    carry = last.select(*keys, "_bin", F.last("_last", ignorenulls=True).over(before_bins(*keys)).alias("_carry"))
    rows = joined(rows, carry, *keys)
    return rows.withColumn(name, F.coalesce(F.lag("_value").over(in_bin(*keys).orderBy(*order)), F.col("_carry"))).drop("_value", "_carry", "_bin")
