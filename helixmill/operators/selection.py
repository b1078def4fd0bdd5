"""Filters by interval, context and window, joins of sites with other tables, and per-read rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.intervals import bed_merge
from helixmill.operators.reads import hashed_share, reads_x_regions

SITE = ["chrom", "site"]

# Upper ends of the quality bins that sequencers write, and the value for each bin.
ILLUMINA_BINS = ((1, 0), (9, 6), (19, 15), (24, 22), (29, 27), (34, 33), (38, 37), (93, 40))


def sites_in_regions(sites: DataFrame, regions: DataFrame, keep: bool = True, bin_size: int = 1000) -> DataFrame:
    """Sites inside any interval, or outside all: merged intervals are cut into bins, so the join is on equal keys."""
    r = bed_merge(regions).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("stop") - 1) / bin_size))))
    r = r.select(F.col("chrom").alias("_chrom"), "_bin", "start", "stop")
    test = (F.col("chrom") == F.col("_chrom")) & (F.floor(F.col("site") / bin_size) == F.col("_bin")) & (F.col("site") >= F.col("start")) & (F.col("site") < F.col("stop"))
    return sites.join(r, test, "left_semi" if keep else "left_anti")


def read_mask(reads: DataFrame, regions: DataFrame) -> DataFrame:
    """Reads that overlap no interval."""
    key = ["read_id", "chrom", "pos", "len"]
    return reads.join(reads_x_regions(reads, regions).select(*key).distinct(), key, "left_anti")


def blacklist_anti(reads: DataFrame, names: DataFrame) -> DataFrame:
    return reads.join(names.select("name").distinct(), "name", "left_anti")


def context_filter(bases: DataFrame, drop: list[tuple[int, int]]) -> DataFrame:
    """Drops bases whose base before in the read (column prev, 4 if there is none) and own base are listed."""
    listed = F.array(*(F.lit(a * 5 + b) for a, b in drop))
    return bases.where(~F.array_contains(listed, (F.col("prev") * 5 + F.col("base")).cast("int")))


def cpg_filter(pile: DataFrame) -> DataFrame:
    """Drops both places of each reference CG. Neighbours meet in a join on the place, not in a window by chromosome."""
    c = pile.where("ref = 1").select("chrom", "site")
    g = pile.where("ref = 2").select("chrom", (F.col("site") - 1).alias("site"))
    first = c.join(g, SITE)
    both = first.unionByName(first.select("chrom", (F.col("site") + 1).alias("site")))
    return pile.join(both, SITE, "left_anti")


def downsample_site_bases(bases: DataFrame, p: float) -> DataFrame:
    """Keeps each base with probability p, drawn from its read and offset."""
    return bases.withColumn("_b", F.expr("read_id * 70 + off")).where(hashed_share("_b") < p).drop("_b")


def window_filter(pile: DataFrame, size: int, most_missing: float) -> DataFrame:
    """Sites of windows of which at most a share of the places is uncovered."""
    rows = pile.withColumn("win", F.floor(F.col("site") / size).cast("long"))
    good = rows.groupBy("chrom", "win").agg(F.count("*").alias("n")).where(1 - F.col("n") / size <= most_missing)
    return rows.join(good.select("chrom", "win"), ["chrom", "win"], "left_semi")


def genome_windows(bases: DataFrame, size: int, skip: int, limit: int) -> DataFrame:
    """Bases and covered places of windows skip to skip + limit - 1 of each chromosome."""
    rows = bases.withColumn("win", F.floor(F.col("site") / size).cast("long")).where(F.col("win").between(skip, skip + limit - 1))
    sites = rows.groupBy("chrom", "win", "site").agg(F.count("*").alias("n"))
    return sites.groupBy("chrom", "win").agg(F.sum("n").alias("n_bases"), F.count("*").alias("n_sites"))


def full_grid(pile: DataFrame, chroms: DataFrame, genome: int, block: int = 4096) -> DataFrame:
    """Every place of each chromosome, with depth 0 where it is uncovered. Places are made block by block, not in one row."""
    starts = chroms.withColumn("_start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(genome - 1).cast("long"), F.lit(block).cast("long"))))
    starts = starts.repartition("chrom", "_start")
    grid = starts.select("chrom", F.explode(F.sequence("_start", F.least(F.col("_start") + block, F.lit(genome)) - 1)).alias("site"))
    return grid.join(pile.select("chrom", "site", "depth"), SITE, "left").select("chrom", "site", F.coalesce("depth", F.lit(0)).alias("depth"))


def multi_sample_sites(bases: DataFrame, least: int) -> DataFrame:
    """Sites at which at least so many samples have data; counted by sample first, so no site's bases are gathered."""
    per = bases.groupBy(*SITE, "sample").agg(F.count("*").alias("n"))
    return per.groupBy(*SITE).agg(F.count("*").alias("n_samples"), F.sum("n").alias("depth")).where(F.col("n_samples") >= least)


def platform_groups(reads: DataFrame, units: DataFrame) -> DataFrame:
    """Gives each read the group whose unit is the first four fields of its name; reads without one keep their group."""
    rows = reads.withColumn("unit", F.substring_index("full_name", ":", 4)).join(units.withColumnRenamed("rg", "_rg"), "unit", "left")
    return rows.withColumn("rg", F.coalesce("_rg", "rg")).drop("_rg")


def end_distances(bases: DataFrame, paired: bool = False) -> DataFrame:
    """d5 and d3: places from the five-prime and three-prime end of what was sequenced, single reads' own ends.

    With paired, bases have proper and frag: the three-prime end of a proper pair's read is that of its fragment.
    """
    last = F.col("len") - 1 - F.col("off")
    reverse = F.col("is_rev") == 1
    d3 = F.when(reverse, F.col("off")).otherwise(last)
    if paired:
        d3 = F.when(F.col("proper") == 1, d3 + F.col("frag") - F.col("len")).otherwise(d3)
    return bases.withColumns({"d5": F.when(reverse, last).otherwise(F.col("off")), "d3": d3})


def clip_mapped_ends(reads: DataFrame, left: int, right: int) -> DataFrame:
    """Turns mapped places at both ends into soft clips; a read too short to keep a place is clipped whole."""
    a = F.least(F.col("len"), F.lit(left))
    b = F.least(F.col("len") - a, F.lit(right))
    return reads.withColumns({"pos": F.col("pos") + a, "clip_left": F.col("clip_left") + a, "clip_right": F.col("clip_right") + b, "len": F.col("len") - a - b})


def trim_soft_clips(reads: DataFrame, keep: int = 0) -> DataFrame:
    return reads.withColumns({c: F.least(F.col(c), F.lit(keep)) for c in ("clip_left", "clip_right")})


def binned_quality(qual: Column, low: int = 0, high: int = 93) -> Column:
    """The quality clamped to a range, then set to the value of its bin."""
    q = F.greatest(F.lit(low), F.least(F.lit(high), qual))
    out = F.lit(ILLUMINA_BINS[-1][1])
    for top, value in reversed(ILLUMINA_BINS[:-1]):
        out = F.when(q <= top, value).otherwise(out)
    return out


def recalibrated(qual: Column, off: Column, intercept: float = 0.1, linear: float = 0.9, place: float = 0.01) -> Column:
    """Error rate by a logistic model of the quality's logit and the place in the read, as phred rounded down."""
    eps = F.pow(F.lit(10.0), -qual / 10)
    eta = intercept + linear * F.ln(eps / (1 - eps)) + place * off
    return F.greatest(F.lit(1), F.floor(-10 * F.log10(1 / (1 + F.exp(-eta))) + 1e-9)).cast("long")


def quality_transformation(bases: DataFrame) -> DataFrame:
    """Bases by group, quality before and after recalibration, and the group's squared correlation of the two."""
    rows = bases.withColumn("q2", recalibrated(F.col("qual"), F.col("off"))).groupBy("rg", F.col("qual").alias("q1"), "q2").agg(F.count("*").alias("n"))
    w = Window.partitionBy("rg")
    wide = lambda c: c.cast("decimal(19,0)")  # noqa: E731  products of two sums pass 64 bits
    n, x, y = F.sum("n").over(w), F.sum(F.expr("n * q1")).over(w), F.sum(F.expr("n * q2")).over(w)
    xx, yy, xy = (F.sum(F.expr(f"n * {e}")).over(w) for e in ("q1 * q1", "q2 * q2", "q1 * q2"))
    less = lambda a, b, c, d: (wide(a) * wide(b) - wide(c) * wide(d)).cast("double")
    top = less(n, xy, x, y)
    return rows.withColumn("r2", F.round(top * top / (less(n, xx, x, x) * less(n, yy, y, y)), 6))


def recalibrate_reads(reads: DataFrame) -> DataFrame:
    """Adds quals, the read's recalibrated qualities; made in the row, so nothing is shuffled."""
    at = F.sequence(F.lit(0).cast("long"), F.col("len") - 1)
    return reads.withColumn("quals", F.transform(at, lambda i: recalibrated(12 + (F.col("k") * 7 + i * 3) % 30, i)))


def covariate_table(bases: DataFrame) -> DataFrame:
    """Counts of each covariate's values by group, over bases of sites deeper than one.

    They are the counts over all bases less those over bases that are alone at their site, which are found by sums: of one
    base a sum is its value. So no base is moved to learn how deep its site is.
    """
    names = ("qual", "off", "mapq", "len", "base")
    pairs = lambda n: F.inline(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).cast("long").alias("value"), n.alias("_n")) for c in names)))
    placed = bases.where(" AND ".join(f"{c} IS NOT NULL" for c in SITE))
    every = placed.select("rg", pairs(F.lit(1).cast("long"))).groupBy("rg", "covariate", "value").agg(F.sum("_n").alias("_n"))
    by_group = placed.groupBy(*SITE, "rg").agg(F.count("*").alias("_c"), *(F.sum(c).alias(c) for c in names))
    alone = by_group.groupBy(*SITE).agg(F.sum("_c").alias("_c"), F.first("rg").alias("rg"), *(F.first(c).alias(c) for c in names)).where("_c = 1")
    rows = every.unionByName(alone.select("rg", pairs(F.lit(-1).cast("long"))))
    return rows.groupBy("rg", "covariate", "value").agg(F.sum("_n").alias("n")).where("n > 0")


def previous_base_table(bases: DataFrame) -> DataFrame:
    """Strand, reference and base against the base before in the read's own direction (column prev, 4 if there is none)."""
    return bases.groupBy("is_rev", "ref", "base").agg(*(F.count_if(F.col("prev") == p).alias(f"prev{p}") for p in range(5)))


def pooled_groups(reads: DataFrame, pools: DataFrame) -> DataFrame:
    """Adds pool: that of the read's group, or the group itself. A group that is in two pools is an error."""
    twice = pools.groupBy("rg").agg(F.count_distinct("pool").alias("_n")).where("_n > 1")
    wrong = F.raise_error(F.concat(F.lit("a read group in two pools: "), F.col("rg")))
    checked = pools.distinct().join(twice, "rg", "left").select("rg", F.when(F.col("_n").isNotNull(), wrong.cast("string")).otherwise(F.col("pool")).alias("_pool"))
    return reads.join(checked, "rg", "left").withColumn("pool", F.coalesce("_pool", "rg")).drop("_pool")


def united(samples: dict[str, DataFrame]) -> DataFrame:
    """The rows of all samples, with the column sample."""
    parts = [rows.withColumn("sample", F.lit(name)) for name, rows in samples.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def known_sites(rows: DataFrame, alleles: DataFrame) -> DataFrame:
    return rows.join(alleles.select(*SITE).distinct(), SITE, "left_semi")


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def top2_alleles(pile: DataFrame) -> DataFrame:
    """The two most frequent bases and their counts; ties go to the earlier base."""
    ranks = F.array_sort(F.array(*(F.struct((-F.col(f"n{b}")).alias("m"), F.lit(k).alias("b")) for k, b in enumerate("acgt"))))
    one, two = F.element_at(ranks, 1), F.element_at(ranks, 2)
    return pile.select(*SITE, one["b"].alias("b1"), (-one["m"]).alias("n1"), two["b"].alias("b2"), (-two["m"]).alias("n2"))


def random_base(bases: DataFrame) -> DataFrame:
    """One base of each site, that of the least number drawn from read and offset."""
    rows = bases.withColumn("_b", F.expr("read_id * 70 + off"))
    rank = F.struct(hashed_share("_b").alias("u"), F.col("_b").alias("b"))
    return rows.groupBy(*SITE).agg(F.min_by("base", rank).alias("call"), F.count("*").alias("depth"))


def consensus_call(capped: DataFrame, depth: int) -> DataFrame:
    """The most frequent of at most depth bases, if it makes up half of depth, rounded up."""
    rows = capped.groupBy(*SITE).agg(*(F.count_if(F.col("base") == b).alias(f"n{'acgt'[b]}") for b in range(4)))
    return top2_alleles(rows).where(F.col("n1") >= (depth + 1) // 2).select(*SITE, F.col("b1").alias("call"), F.col("n1").alias("n"))


def allele_balance(pile: DataFrame) -> DataFrame:
    """Share of the reference base, and the two-sided exact binomial p of the counts at one half.

    p is worked out once for each distinct pair of counts; each term follows from the one before it.
    """
    n, k = F.col("ref_depth") + F.col("alt_depth"), F.least("ref_depth", "alt_depth")
    first = F.struct((-n * F.ln(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        return F.struct((acc["t"] + F.ln((n - i) / (i + 1))).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), first, add, lambda acc: acc["s"])
    rows = pile.select("ref_depth", "alt_depth").distinct().withColumn("ai", F.round(F.least(F.lit(1.0), 2 * tail) + 1e-10, 6))
    return pile.join(rows, ["ref_depth", "alt_depth"]).select(*SITE, F.round(F.col("ref_depth") / n, 6).alias("ab"), "ai")


def encode_genotypes(calls: DataFrame, genotypes) -> DataFrame:
    """gt and alt of each call against the reference: 0/0, 0/1, 1/1 or 1/2."""
    a = F.element_at(F.array(*(F.lit(x) for x, _ in genotypes)), (F.col("genotype") + 1).cast("int"))
    b = F.element_at(F.array(*(F.lit(y) for _, y in genotypes)), (F.col("genotype") + 1).cast("int"))
    letter = lambda c: F.element_at(F.array(*map(F.lit, "ACGT")), c + 1)
    rows = calls.withColumns({"_a": a, "_b": b})
    ra, rb = F.col("_a") == F.col("ref"), F.col("_b") == F.col("ref")
    gt = F.when(ra & rb, "0/0").when(ra | rb, "0/1").when(F.col("_a") == F.col("_b"), "1/1").otherwise("1/2")
    alt = F.when(ra & rb, ".").when(ra, letter(F.col("_b"))).when(rb | (F.col("_a") == F.col("_b")), letter(F.col("_a"))).otherwise(F.concat_ws(",", letter(F.col("_a")), letter(F.col("_b"))))
    return rows.select(*SITE, gt.alias("gt"), alt.alias("alt"))


def bed_windows(bases: DataFrame, windows: DataFrame, genome: int, bin_size: int = 1000) -> DataFrame:
    """Bases and covered places of each window of a list, which are clipped to the chromosome and may overlap; win is its name.

    Sites are counted before they meet windows, on equal keys of bins; windows without data have no row.
    """
    sites = bases.groupBy(*SITE).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("site") / bin_size))
    w = windows.select("chrom", "win", F.greatest("start", F.lit(0)).alias("_a"), F.least("stop", F.lit(genome)).alias("_b")).where("_a < _b")
    w = w.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_a") / bin_size), F.floor((F.col("_b") - 1) / bin_size))))
    rows = sites.join(w, ["chrom", "_bin"]).where("site >= _a AND site < _b")
    return rows.groupBy("chrom", "win").agg(F.sum("_n").alias("n_bases"), F.count("*").alias("n_sites"))
