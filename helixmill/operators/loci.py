"""Sites joined with references, regions and samples; reads as alignments and text; allele pairs over samples."""

from __future__ import annotations

from itertools import combinations
from math import exp

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators.intervals import sites_to_intervals
from helixmill.operators.reads import hashed_share, make_single
from helixmill.operators.selection import trim_soft_clips

SITE = ["chrom", "site"]
PAIRS = tuple(combinations(range(4), 2))


def pairs_listing(pairs: DataFrame) -> DataFrame:
    """A row for each mate of each pair."""
    mates = F.array(*(F.struct(F.lit(k).alias("mate"), F.col(f"pos{k}").alias("pos"), F.col(f"len{k}").alias("len")) for k in (1, 2)))
    return pairs.where("status = 'pair'").select("name", "rg", "chrom", F.inline(mates))


def downsample_bases(bases: DataFrame, p: float) -> DataFrame:
    """Each base becomes N (4) with probability p, drawn from the read and the place in it."""
    return bases.withColumn("base", F.when(hashed_share("read_id", "off") < p, F.lit(4).cast("long")).otherwise(F.col("base")))


def pileup_to_bed(pile: DataFrame, low: int, high: int) -> DataFrame:
    return sites_to_intervals(pile.where(F.col("depth").between(low, high)).select(*SITE))


def bases_x_reference(bases: DataFrame, reference: DataFrame) -> DataFrame:
    """Bases with the reference base of their site, N (4) where the reference has none."""
    return bases.drop("ref").join(reference.select(*SITE, "ref"), SITE, "left").withColumn("ref", F.coalesce("ref", F.lit(4).cast("long")))


def common_sites(bases: DataFrame, sample: str) -> DataFrame:
    """For each two samples the number of sites that have data in both: one row per site, as many pairs as samples allow."""
    by = bases.groupBy(*SITE).agg(F.array_sort(F.collect_set(sample)).alias("_s"))
    sets = by.groupBy("_s").agg(F.count("*").alias("_n"))
    pairs = sets.select(F.explode("_s").alias("s1"), "_s", "_n").select("s1", F.explode("_s").alias("s2"), "_n").where("s1 < s2")
    return pairs.groupBy("s1", "s2").agg(F.sum("_n").alias("n"))


def from_to_table(bases: DataFrame) -> DataFrame:
    """Distances of two random non-reference bases at A and T sites with two or more, and at most half, of them."""
    rows, odd = bases.where("ref IN (0, 3)"), F.col("base") != F.col("ref")
    sites = rows.groupBy(*SITE).agg(F.count("*").alias("_n"), F.count_if(odd).alias("_k")).where("_k >= 2 AND 2 * _k <= _n")
    draw = Window.partitionBy(*SITE).orderBy(hashed_share("read_id", "off"), "read_id", "off")
    two = rows.where(odd).select(*SITE, "off", F.row_number().over(draw).alias("_i")).where("_i <= 2")
    two = two.groupBy(*SITE).agg(F.max(F.when(F.col("_i") == 1, F.col("off"))).alias("first"), F.max(F.when(F.col("_i") == 2, F.col("off"))).alias("second"))
    return two.join(sites.select(*SITE), SITE, "left_semi").groupBy("first", "second").agg(F.count("*").alias("n"))


def window_priors(sites_freqs: DataFrame, theta: float) -> DataFrame:
    """The ten genotype priors of a window from its base frequencies f_a, f_c, f_g and f_t."""
    e, f = exp(-theta), [F.col(f"f_{b}") for b in "acgt"]
    w = [f[a] * (e + f[a] * (1 - e)) if a == b else 2 * f[a] * f[b] * (1 - e) for a, b in GENOTYPES]
    total = sum(w)
    return sites_freqs.select("chrom", "win", *(F.round(x / total, 6).alias(f"p{i}") for i, x in enumerate(w)))


def top2_genotypes(sites: DataFrame) -> DataFrame:
    """Best and second-best genotype of a site; the earlier of equal ones first."""
    ranked = F.array_sort(F.transform("logs", lambda x, i: F.struct((-x).alias("m"), i.cast("long").alias("g"))))
    return sites.withColumn("_r", ranked).select(*SITE, F.expr("_r[0].g").alias("best"), F.expr("_r[1].g").alias("second"))


def flanks(places: DataFrame, reference: DataFrame, width: int) -> DataFrame:
    """The reference around each place, N where it has no base: a row of 2 * width + 1 letters."""
    rows = places.select(*SITE, F.explode(F.sequence(F.col("site") - width, F.col("site") + width)).alias("_at"))
    ref = reference.select("chrom", F.col("site").alias("_at"), F.substring(F.lit("ACGT"), (F.col("ref") + 1).cast("int"), F.lit(1)).alias("_r"))
    rows = rows.join(ref, ["chrom", "_at"], "left").groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_r", F.lit("N")).alias("c")))).alias("_l"))
    return rows.select(*SITE, F.array_join(F.transform("_l", lambda x: x["c"]), "").alias("flank"))


def major_minor(sites: DataFrame) -> DataFrame:
    """The likeliest allele pair of a site over samples, under Hardy-Weinberg proportions at frequency one half.

    Six sums a site; sites has a row for each sample. Of equal pairs the first is taken. Likelihoods are rounded to
    nine places before they are compared.
    """
    g = {pair: F.element_at("gl", i + 1) for i, pair in enumerate(GENOTYPES)}
    sums = [F.sum(F.ln(0.25 * g[a, a] + 0.5 * g[a, b] + 0.25 * g[b, b])).alias(f"_p{i}") for i, (a, b) in enumerate(PAIRS)]
    rows = sites.groupBy(*SITE).agg(F.count("*").alias("n_samples"), *sums)
    rows = rows.withColumn("_l", F.array(*(F.round(f"_p{i}", 9) for i in range(6))))
    return rows.select(*SITE, "n_samples", (F.array_position("_l", F.array_max("_l")) - 1).cast("long").alias("allele_pair"), F.round(F.greatest(*(f"_p{i}" for i in range(6))), 6).alias("ll"))


def lifted(reads: DataFrame) -> DataFrame:
    """info, chrom and site of the place that each read's name carries, where that place of the read is aligned.

    A name is a source, an offset in the read and the place's info, joined by underscores; reads have cigar lengths of
    clips and matches only. A read clipped there has no row.
    """
    part = F.split("name", "_")
    rows = reads.withColumns({"_at": F.get(part, F.lit(1)).cast("long"), "info": F.get(part, F.lit(2))})
    inside = (F.col("_at") >= F.col("clip_left")) & (F.col("_at") < F.col("clip_left") + F.col("len"))
    return rows.where(inside).select("info", "chrom", (F.col("pos") + F.col("_at") - F.col("clip_left")).alias("site"))


def cycle_transitions(bases: DataFrame) -> DataFrame:
    """Reference to base by strand and cycle, over the bases of proper pairs: for each mate, and for both (mate 0).

    Cycles of a reverse read count from its other end; for both, the second mate's follow the first one's (column ahead).
    """
    cycle = F.when(F.col("is_rev") == 1, F.col("len") - 1 - F.col("off")).otherwise(F.col("off"))
    mate = F.col("is_second") + 1
    each = F.inline(F.array(F.struct(mate.cast("int").alias("mate"), cycle.alias("cycle")), F.struct(F.lit(0).alias("mate"), (cycle + F.when(mate == 2, F.col("ahead")).otherwise(0)).alias("cycle"))))
    rows = bases.where("base < 4").select("is_rev", "ref", "base", each).groupBy("mate", "is_rev", "cycle", "ref", "base").agg(F.count("*").alias("n"))
    return rows.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("mate", "is_rev", "cycle", "ref")), 4))


def consistent_pairs(filtered: DataFrame, keep_orphans: bool = False, single: str | None = None, remove_clips: bool = False) -> DataFrame:
    """Reads without a reason to drop them; a paired one only if both mates are left, or if orphans stay.

    With single, pairs become single reads: the named mate (first or second) stays. With remove_clips soft clips go.
    """
    kept = filtered.where("reason IS NULL")
    paired = (F.col("flag").bitwiseAND(F.lit(1)) > 0).cast("int")
    mates = F.sum(paired).over(Window.partitionBy("name"))  # a name has two mates
    rows = kept.withColumn("_m", mates).where(F.lit(keep_orphans) | (paired == 0) | (F.col("_m") == 2)).drop("_m")
    rows = make_single(rows, single) if single else rows
    return trim_soft_clips(rows) if remove_clips else rows
