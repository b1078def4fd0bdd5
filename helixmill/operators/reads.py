"""Operators on reads: filters and their audit, duplicates, groups, histograms, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.binned import previous
from helixmill.operators.intervals import bed_merge
from helixmill.operators.sized import few

PAIRED, PROPER, UNMAPPED, REVERSE, FIRST, SECOND, SECONDARY, FAILED, DUPLICATE, SUPPLEMENTARY = 1, 2, 4, 16, 64, 128, 256, 512, 1024, 2048


def has(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def read_filter(
    reads: DataFrame, mapped_length=(0, 500), mapq=None, length=None, soft_clip=None, groups=None, strand=None, mate=None,
    pmds=None, blacklist: DataFrame | None = None, fragment=None, longer_than_fragment: bool = False, external: Column | None = None, keep_all: bool = False,
) -> DataFrame:
    """Adds reason: the first filter that a read fails, in the fixed order, or null for a read to keep.

    blacklist has the names to drop. pmds bounds the column ds from above; a read without one passes. fragment bounds the
    column frag; longer_than_fragment drops proper pairs whose tlen is shorter than their aligned length. external is a
    task's own test of reads to keep. With keep_all only the mapped length counts. len counts aligned bases; the read's
    length has inserted and clipped ones too, and the mapped length those deleted and skipped, where reads have such columns.
    """
    rows = reads
    more = lambda *names: sum((F.col(c) for c in names if c in reads.columns), F.lit(0).cast("long"))
    if blacklist is not None:
        rows = rows.join(blacklist.select("name").distinct().withColumn("_listed", F.lit(True)), "name", "left")
    clipped = F.col("clip_left") + F.col("clip_right")
    whole, mapped = F.col("len") + more("inserted") + clipped, F.col("len") + more("deleted", "skipped")
    between = lambda c, bounds: ~F.col(c).between(*bounds)
    tests: list[tuple[str, bool, Column]] = [
        ("Duplicate", True, has(DUPLICATE)),
        ("SoftClipped", soft_clip is not None, clipped / whole > (soft_clip or 0)),
        ("PMDS", pmds is not None, F.col("ds") >= (pmds or 0) if pmds is not None else F.lit(False)),
        ("ImproperPairs", True, has(PAIRED) & ~has(PROPER)),
        ("Unmapped", True, has(UNMAPPED)),
        ("FailedQC", True, has(FAILED)),
        ("Secondary", True, has(SECONDARY)),
        ("Supplementary", True, has(SUPPLEMENTARY)),
        ("ReadGroup", groups is not None, ~F.col("rg").isin(list(groups or []))),
        ("FwdStrand", strand == "reverse", ~has(REVERSE)),
        ("RevStrand", strand == "forward", has(REVERSE)),
        ("FirstMate", mate == "first", ~has(FIRST)),
        ("SecondMate", mate == "second", ~has(SECOND)),
        ("MappingQuality", mapq is not None, between("mapq", mapq or (0, 0))),
        ("Blacklist", blacklist is not None, F.col("_listed") if blacklist is not None else F.lit(False)),
        ("ReadLength", length is not None, ~whole.between(*(length or (0, 0)))),
        ("FragmentLength", fragment is not None, between("frag", fragment) if fragment is not None else F.lit(False)),
        ("LongerThanFragment", longer_than_fragment, has(PROPER) & (F.abs("tlen") < F.col("len")) if longer_than_fragment else F.lit(False)),
        ("External", external is not None, ~external if external is not None else F.lit(False)),
    ]
    reason = F.lit(None).cast("string")
    for name, on, fails in reversed(tests):
        if on and not keep_all:
            reason = F.when(fails, F.lit(name)).otherwise(reason)
    reason = F.when(~mapped.between(*mapped_length), F.lit("MappedLength")).otherwise(reason)
    return rows.withColumn("reason", reason).drop("_listed")


def filter_audit(filtered: DataFrame) -> DataFrame:
    """Reads by read group, chromosome and reason; kept reads have reason ``kept``."""
    return filtered.groupBy("rg", "chrom", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def reset_duplicates(reads: DataFrame) -> DataFrame:
    return reads.withColumn("flag", F.col("flag").bitwiseAND(F.lit(~DUPLICATE)))


def mark_duplicates(reads: DataFrame, within: int = 0, by_group: bool = True) -> DataFrame:
    """Adds is_dup: start and fragment end each differ by ``within`` at most from the read before on the chromosome.

    Reads that are flagged already are not looked at and are nobody's read before; one just marked is. Reads have frag.
    """
    keys = ["rg", "chrom"] if by_group else ["chrom"]
    at = F.struct(F.col("pos").alias("start"), (F.col("pos") + F.col("frag")).alias("stop"))
    rows = previous(reads.where(~has(DUPLICATE)), keys, ["pos", "read_id", "frag"], at)
    near = (F.col("pos") - F.col("_before.start") <= within) & (F.abs(F.col("pos") + F.col("frag") - F.col("_before.stop")) <= within)
    rows = rows.withColumn("is_dup", F.coalesce(near, F.lit(False)).cast("int")).drop("_before")
    return rows.unionByName(reads.where(has(DUPLICATE)).withColumn("is_dup", F.lit(1)))


def potential_duplicates(reads: DataFrame) -> DataFrame:
    """Neighbours in a group with equal start and fragment length (column frag): both ids, fragments and strands."""
    own = reads.select("rg", "chrom", "pos", "frag", has(REVERSE).cast("int").alias("is_rev"), "read_id")
    rows = previous(own, ["rg", "chrom"], ["pos", "read_id", "frag"], F.struct("pos", "frag", "is_rev", "read_id"))
    rows = rows.where("_before.pos = pos AND _before.frag = frag")
    return rows.select("rg", "chrom", "pos", "frag", "is_rev", "read_id", F.col("_before.read_id").alias("previous_id"), F.col("_before.is_rev").alias("previous_rev"))


def read_distance(reads: DataFrame, most: int = 10_000) -> DataFrame:
    """Histogram, by group, of the distance to the read before on the chromosome, capped."""
    gaps = previous(reads.select("rg", "chrom", "pos", "read_id"), ["rg", "chrom"], ["pos", "read_id"], F.col("pos"))
    gaps = gaps.where("_before IS NOT NULL").withColumn("distance", F.col("pos") - F.col("_before"))
    return gaps.groupBy("rg", F.least(F.lit(most), F.col("distance")).alias("distance")).agg(F.count("*").alias("n"))


def start_multiplicity(reads: DataFrame) -> DataFrame:
    starts = reads.groupBy("rg", "chrom", "pos").agg(F.count("*").alias("reads_at_start"))
    return starts.groupBy("rg", "reads_at_start").agg(F.count("*").alias("n"))


def bam_diagnostics(reads: DataFrame) -> DataFrame:
    """Totals and means for each group and chromosome, each alone, and all; 'all' and 0 mark what is combined.

    reads have a filter's reason; those without one passed.
    """
    return reads.cube("rg", "chrom").agg(
        F.count("*").alias("n"), F.count_if(F.col("reason").isNull()).alias("n_passed"), F.count_if(has(DUPLICATE)).alias("n_duplicates"), F.count_if(has(PROPER)).alias("n_proper"), F.count_if(has(PAIRED)).alias("n_paired"),
        F.max("len").alias("max_length"), F.round(F.avg("len"), 6).alias("mean_length"), F.round(F.avg("mapq"), 6).alias("mean_mapq"),
        F.round(F.avg(F.col("clip_left") + F.col("clip_right")), 6).alias("mean_clip"), F.round(F.avg("frag"), 6).alias("mean_fragment"),
    ).withColumns({"rg": F.coalesce("rg", F.lit("all")), "chrom": F.coalesce("chrom", F.lit(0))})


def bam_histograms(reads: DataFrame) -> DataFrame:
    """Histograms of length, mapping quality, clipped and fragment length, by group, mate and strand, and groups combined."""
    measures = F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), c.cast("long").alias("value")) for m, c in (("length", F.col("len")), ("mapq", F.col("mapq")), ("clip", F.col("clip_left") + F.col("clip_right")), ("fragment", F.col("frag"))))))
    by = [F.when(has(PAIRED), F.when(has(SECOND), 2).otherwise(1)).otherwise(0).alias("mate"), has(REVERSE).cast("int").alias("is_rev")]
    counts = reads.select("rg", *by, measures).groupBy("rg", "mate", "is_rev", "measure", "value").agg(F.count("*").alias("n"))
    return counts.unionByName(counts.groupBy("mate", "is_rev", "measure", "value").agg(F.sum("n").alias("n")).withColumn("rg", F.lit("all")))


def average_depth(reads: DataFrame, genome: int) -> DataFrame:
    return reads.groupBy("chrom").agg(F.sum("len").alias("aligned"), F.round(F.sum("len") / genome, 6).alias("depth"))


def soft_clip_matrix(reads: DataFrame) -> DataFrame:
    """Reads by length and clipped length, for left, right and both ends."""
    ends = F.inline(F.array(*(F.struct(F.lit(e).alias("clip_end"), c.alias("clipped")) for e, c in (("left", F.col("clip_left")), ("right", F.col("clip_right")), ("both", F.col("clip_left") + F.col("clip_right"))))))
    return reads.select("len", ends).groupBy("clip_end", "len", "clipped").agg(F.count("*").alias("n"))


def flag_audit(reads: DataFrame) -> DataFrame:
    """Reads whose flags contradict each other, by group: mate bits of an unpaired read, or both or no mate bit of a paired one."""
    odd = (~has(PAIRED) & (has(PROPER) | has(FIRST) | has(SECOND))) | (has(PAIRED) & (has(FIRST) == has(SECOND))) | (has(UNMAPPED) & has(PROPER))
    return reads.groupBy("rg").agg(F.count_if(odd).alias("n_odd"), F.count("*").alias("n"))


def make_single(reads: DataFrame, mate: str = "first") -> DataFrame:
    """Keeps one mate of each pair and all single reads, and clears the bits of pairs."""
    kept = reads.where(~has(PAIRED) | has(FIRST if mate == "first" else SECOND))
    return kept.withColumn("flag", F.col("flag").bitwiseAND(F.lit(~(PAIRED | PROPER | 8 | 32 | FIRST | SECOND))))


def merge_read_groups(reads: DataFrame, merges: dict[str, list[str]]) -> DataFrame:
    """Donor groups become their receiver; merges come from a file that the user writes, so they are few."""
    return reads.replace({d: r for r, donors in merges.items() for d in donors}, subset=["rg"])


def hashed_share(*keys: str, seed: int = 0) -> Column:
    """A number in [0, 1) drawn from keys by arithmetic that every engine shares; a key that is no whole number counts by its hash."""
    h = F.lit(seed).cast("long")
    for k in keys:
        number = F.when(F.col(k).isNotNull(), F.coalesce(F.col(k).try_cast("long"), F.pmod(F.xxhash64(k), F.lit(2147483647))))
        h = F.pmod(h * 48271 + number * 69621 + 12345, F.lit(2147483647))
    return F.pmod(h * 16807, F.lit(2147483647)) / 2147483647.0


def sample_reads(reads: DataFrame, p: float, *keys: str) -> DataFrame:
    return reads.where(hashed_share(*(keys or ("read_id",))) < p)


def downsample_reads(reads: DataFrame, probabilities: list[float]) -> DataFrame:
    """A copy of the kept reads for each probability; mates, which share a name, share the draw."""
    draws = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), hashed_share("name", seed=i).alias("u")) for i, p in enumerate(probabilities))))
    return reads.withColumn("_d", draws).where("_d.u < _d.p").withColumn("p", F.col("_d.p")).drop("_d")


def split_reads(reads: DataFrame, shares: list[float]) -> DataFrame:
    """Adds part: disjoint outputs drawn by name; a read beyond all shares has none."""
    u, part, low = hashed_share("name"), F.lit(None).cast("int"), 0.0
    for i, s in enumerate(shares):
        part = F.when((u >= low) & (u < low + s), F.lit(i)).otherwise(part)
        low += s
    return reads.withColumn("part", part)


def pair_mates(mates: DataFrame, distance: int = 2000) -> DataFrame:
    """Mates by name, group and chromosome within a distance; a read without one is an orphan."""
    a, b = mates.where("is_second = 0"), mates.where("is_second = 1")
    keys = ["name", "rg", "chrom"]
    both = a.select(*keys, F.col("pos").alias("pos1"), F.col("len").alias("len1")).join(b.select(*keys, F.col("pos").alias("pos2"), F.col("len").alias("len2")), keys, "full")
    near = F.coalesce(F.abs(F.col("pos2") - F.col("pos1")) <= distance, F.lit(False))
    return both.withColumn("status", F.when(near, "pair").otherwise("orphan"))


def reads_x_regions(reads: DataFrame, regions: DataFrame, bin_size: int = 1000) -> DataFrame:
    """Reads that overlap any interval. Intervals are merged, and both sides are cut into bins, so the join is on equal keys
    and a place of a read meets one interval at most, however many lie there."""
    bins = lambda start, stop: F.explode(F.sequence(F.floor(start / bin_size), F.floor((stop - 1) / bin_size)))
    r = few(bed_merge(regions.where("start < stop")).withColumn("_bin", bins(F.col("start"), F.col("stop"))))
    hit = reads.withColumn("_bin", bins(F.col("pos"), F.col("pos") + F.col("len"))).join(r, ["chrom", "_bin"]).where("pos < stop AND pos + len > start")
    key = ["read_id", "chrom", "pos", "len"]
    return reads.join(hit.select(*key).distinct(), key, "left_semi")


MERGING = ("middle", "random", "keepFirst", "keepSecond", "keepFwd", "keepRev")


def merge_overlapping_mates(pairs: DataFrame, method: str = "middle") -> DataFrame:
    """Classifies pairs and tells how many overlapping places each strand loses: the forward mate on its right, the reverse on its left.

    pairs have rev1 and rev2, whether the mates are reverse. Mates of one strand, and a reverse mate that starts or ends
    before the forward one, are classes of their own, whose pairs are dropped (kept is false). An odd overlap in the middle
    costs the first mate one more.
    """
    first = F.col("rev1") == 0  # the first mate is the forward one
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    f_end, r_start, r_end = pick("pos1", "pos2") + pick("len1", "len2"), pick("pos2", "pos1"), pick("pos2", "pos1") + pick("len2", "len1")
    overlap = f_end - r_start
    kind = F.when(F.col("rev1") == F.col("rev2"), F.when(first, "both_forward").otherwise("both_reverse"))
    kind = kind.when(r_start < pick("pos1", "pos2"), "rev_starts_first").when(r_end < f_end, "rev_ends_first").when(overlap <= 0, "no_overlap").otherwise("overlap")
    half = F.floor(overlap / 2) + F.when(first, overlap % 2).otherwise(0)
    lost = {"middle": half, "random": F.when(hashed_share("name") < 0.5, overlap).otherwise(0), "keepFirst": F.when(first, 0).otherwise(overlap), "keepSecond": F.when(first, overlap).otherwise(0), "keepFwd": F.lit(0), "keepRev": overlap}[method]
    rows = pairs.where("status = 'pair'").withColumn("class", kind).withColumn("_o", F.when(F.col("class") == "overlap", overlap).otherwise(0))
    f_clip = F.when(F.col("class") == "overlap", lost).otherwise(0).cast("long")
    return rows.select("name", "rg", "chrom", "class", F.col("class").isin("overlap", "no_overlap").alias("kept"), f_clip.alias("f_clip"), (F.col("_o") - f_clip).cast("long").alias("r_clip"))
