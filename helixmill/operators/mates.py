"""What becomes of a name's reads: pairs, orphans, and mates that a filtered or improper mate takes along.

A name's reads meet in one aggregate that keeps its first and its last read, so a name on many rows is combined before it
is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.reads import hashed_share, reads_x_regions

READ = ("pos", "read_id", "len", "rg", "proper", "passed", "hit")


def mate_states(reads: DataFrame, regions: DataFrame | None = None, keep_inside: bool = False, porosity: float = 0.0, distance: int = 2000) -> DataFrame:
    """read_id and status of every read, taken by chromosome in the order of (pos, read_id).

    reads: read_id, name, rg, chrom, pos, len, and the booleans paired, proper and passed (whether all filters kept it).

    - filtered: it did not pass.
    - poisoned: its earlier mate was filtered though proper, or is improper; dropped with it.
    - orphan: paired, but without a mate that passed within the distance; an improper first mate is one.
    - repeated: one of three or more reads of its name, none of which can be said to be the mate of another.
    - mismatch: its mate is of another group.
    - masked: judged by the regions. Without keep_inside a single read goes if it overlaps any, and a pair if either mate
      does; with it a single read goes if it overlaps none, and a pair if neither does. Reads that would go are kept
      with probability porosity, drawn by name (unpaired ones: by read_id), so mates share it.
    - pair, single: kept.

    Paired reads without a name are orphans. Reads with no flag or place set count as not proper, not passed, not overlapping.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = reads.select("read_id", "name", "rg", "chrom", "pos", "len", yes("paired"), yes("proper"), yes("passed"))
    if regions is None:
        rows = rows.withColumn("hit", F.lit(keep_inside))
    else:
        key = ["read_id", "chrom", "pos", "len"]
        hits = reads_x_regions(rows, regions).select(*key).distinct().withColumn("hit", F.lit(True))
        rows = rows.join(hits, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def gone(hit: Column, share: Column) -> Column:
        return (~hit if keep_inside else hit) & (share >= porosity)

    alone = F.when(~F.col("passed"), "filtered").when(F.col("paired"), "orphan").when(gone(F.col("hit"), hashed_share("read_id")), "masked").otherwise("single")
    singles = rows.where(~F.col("paired") | F.col("name").isNull()).select("read_id", alone.alias("status"))

    paired = rows.where(F.col("paired") & F.col("name").isNotNull())
    one = F.struct(*READ)
    names = paired.groupBy("chrom", "name").agg(F.count("*").alias("n"), F.min(one).alias("a"), F.max(one).alias("b"))
    a, b, two = F.col("a"), F.col("b"), F.col("n") == 2
    waits = a["passed"] & a["proper"]
    poison = F.when(a["passed"], ~a["proper"]).otherwise(a["proper"])
    met = two & waits & b["passed"] & F.coalesce(b["pos"] - a["pos"] <= distance, F.lit(False))
    both = F.when(~a["rg"].eqNullSafe(b["rg"]), "mismatch").when(gone(a["hit"] | b["hit"], hashed_share("name")), "masked").otherwise("pair")
    of_a = F.when(~a["passed"], "filtered").when(met, both).otherwise("orphan")
    of_b = F.when(~b["passed"], "filtered").when(poison, "poisoned").when(met, both).otherwise("orphan")
    said = lambda read, status: F.struct(read["read_id"].alias("read_id"), status.alias("status"))
    few = names.where("n <= 2").select(F.inline(F.when(two, F.array(said(a, of_a), said(b, of_b))).otherwise(F.array(said(a, of_a)))))
    many = paired.join(names.where("n > 2").select("chrom", "name"), ["chrom", "name"], "left_semi")
    many = many.select("read_id", F.when(F.col("passed"), "repeated").otherwise("filtered").alias("status"))
    return singles.unionByName(few).unionByName(many)
