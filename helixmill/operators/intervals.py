"""Interval operators: merge, complement, difference, sites to intervals. Windows span a bin of places, not a chromosome."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.binned import SIZE, before_bins, in_bin, joined, previous, with_bin


def bed_merge(regions: DataFrame, size: int = SIZE) -> DataFrame:
    """Disjoint intervals that cover the same places; touching ones become one.

    Intervals are merged by the bin of their start. Those that begin within the reach of the bins before belong to the
    last interval that begins there with nothing before it. Of those with one start the longest stands for all, so no two
    rows of a window are equal in its order, and a bin has a row for each place at most.
    """
    rows, w = with_bin(regions.groupBy("chrom", "start").agg(F.max("stop").alias("stop")), "start", size), in_bin("chrom").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("chrom", "_bin", "_run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("_run")
    ends = rows.groupBy("chrom", "_bin").agg(F.max("stop").alias("_stop"), F.max("start").alias("_start"))
    ends = ends.withColumn("_reach", F.max("_stop").over(before_bins("chrom")))
    head = F.when(F.col("_reach").isNull() | (F.col("_start") > F.col("_reach")), F.col("_start"))
    ends = ends.select("chrom", "_bin", "_reach", F.max(head).over(before_bins("chrom")).alias("_head"))
    rows = joined(rows, ends, "chrom")
    first = F.when(F.col("start") <= F.col("_reach"), F.col("_head")).otherwise(F.col("start"))
    return rows.groupBy("chrom", first.alias("start")).agg(F.max("stop").alias("stop"))


def sites_to_intervals(sites: DataFrame, size: int = SIZE) -> DataFrame:
    """Runs of neighbouring distinct sites as half-open intervals."""
    rows = with_bin(sites.select("chrom", "site"), "site", size)
    rows = rows.withColumn("_g", F.col("site") - F.row_number().over(in_bin("chrom").orderBy("site")))
    runs = rows.groupBy("chrom", "_bin", "_g").agg(F.min("site").alias("start"), (F.max("site") + 1).alias("stop"))
    return bed_merge(runs, size)


def regions_complement(regions: DataFrame, genome: int, chroms: DataFrame) -> DataFrame:
    """What regions leave of [0, genome) on each of chroms."""
    edge = lambda at: chroms.select("chrom", F.lit(at).cast("long").alias("start"), F.lit(at).cast("long").alias("stop"))
    rows = bed_merge(regions).unionByName(edge(0)).unionByName(edge(genome))
    rows = previous(rows, ["chrom"], ["start", "stop"], F.col("stop"), "_until")
    return rows.where("_until < start").select("chrom", F.col("_until").alias("start"), F.col("start").alias("stop"))


def regions_except(regions: DataFrame, mask: DataFrame, size: int = SIZE) -> DataFrame:
    """What of the regions no mask covers. Both are cut at the edges of bins; a bin's running sums of begins and ends tell."""

    def edges(rows: DataFrame, r: int, m: int) -> DataFrame:
        rows = bed_merge(rows).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))))
        a, b = F.greatest("start", F.col("_bin") * size), F.least("stop", (F.col("_bin") + 1) * size)
        point = lambda at, k: F.struct(at.alias("at"), F.lit(k * r).alias("r"), F.lit(k * m).alias("m"))
        return rows.select("chrom", "_bin", F.inline(F.array(point(a, 1), point(b, -1))))

    points = edges(regions, 1, 0).unionByName(edges(mask, 0, 1)).groupBy("chrom", "_bin", "at").agg(F.sum("r").alias("r"), F.sum("m").alias("m"))
    w = in_bin("chrom").orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = points.select("chrom", F.col("at").alias("start"), F.lead("at").over(w).alias("stop"), F.sum("r").over(upto).alias("r"), F.sum("m").over(upto).alias("m"))
    return bed_merge(rows.where("r > 0 AND m = 0 AND stop IS NOT NULL"), size)
