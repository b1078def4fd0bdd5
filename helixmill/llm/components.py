"""Connected components of an edge table by alternating large and small stars.

Minima and edges are written to the shared folder at each step, so a join reads both sides through an exchange and
Spark can split a node with very many edges; the number of steps grows with the logarithm of a component's width.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixmill.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: long columns a and b. Returns node and root, the smallest node reachable, for every node that has an edge."""
    at = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at, mark = stored(at), None
    while mark != (mark := _mark(at)):
        twice = at.union(at.select("v", "u"))
        least = stored(twice.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = stored(twice.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = stored(small.union(least.select("u", "m")).distinct())
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
