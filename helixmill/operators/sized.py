"""Joins with tables that are small as a rule: broadcast only after a count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 100_000


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, broadcast where it has at most so many rows; else left to a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
