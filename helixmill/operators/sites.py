"""Operators on bases and sites: pileups, histograms, likelihoods, calls, masks, and models fitted over all sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES, genotype_logs, quality_terms, scaled_ten
from helixmill.operators.intervals import regions_complement, sites_to_intervals

KEY = ["chrom", "site"]
BASES = "ACGT"


def base_quality_filter(bases: DataFrame, low: int = 1, high: int = 93) -> DataFrame:
    return bases.where(F.col("qual").between(low, high))


def trim_ends(bases: DataFrame, trim5: int, trim3: int) -> DataFrame:
    """Bases closer to an end than the trims become N (4), so depth stays; on reverse reads the ends are swapped."""
    d5 = F.when(F.col("is_rev") == 1, F.col("len") - 1 - F.col("off")).otherwise(F.col("off"))
    return bases.withColumn("base", F.when((d5 >= trim5) & (F.col("len") - 1 - d5 >= trim3), F.col("base")).otherwise(F.lit(4).cast("long")))


def _counts() -> list[Column]:
    return [F.count_if(F.col("base") == b).alias(f"n{BASES[b].lower()}") for b in range(4)]


def pileup(bases: DataFrame) -> DataFrame:
    """Depth, counts of each base, number of alleles, reference and other depth at each covered site."""
    rows = bases.groupBy(*KEY, "ref").agg(F.count("*").alias("depth"), *_counts())
    alleles = sum(F.when(F.col(f"n{b.lower()}") > 0, 1).otherwise(0) for b in BASES)
    ref = F.element_at(F.array("na", "nc", "ng", "nt"), (F.col("ref") + 1).cast("int"))
    return rows.withColumns({"n_alleles": alleles, "ref_depth": ref}).withColumn("alt_depth", F.col("depth") - F.col("ref_depth"))


def strand_mate_counts(bases: DataFrame) -> DataFrame:
    return bases.groupBy(*KEY).agg(F.count_if(F.col("is_rev") == 0).alias("n_forward"), F.count_if(F.col("is_rev") == 1).alias("n_reverse"))


def rms_mapq(bases: DataFrame) -> DataFrame:
    return bases.groupBy(*KEY).agg(F.floor(F.sqrt(F.avg(F.col("mapq") * F.col("mapq")))).cast("long").alias("rms_mapq"))


def depth_histogram(bases: DataFrame) -> DataFrame:
    return bases.groupBy(*KEY).agg(F.count("*").alias("depth")).groupBy("chrom", "depth").agg(F.count("*").alias("n"))


def quality_histogram(bases: DataFrame) -> DataFrame:
    """Bases by group and quality (column qual, recalibrated or not), and groups combined."""
    counts = bases.groupBy("rg", "qual").agg(F.count("*").alias("n"))
    return counts.unionByName(counts.groupBy("qual").agg(F.sum("n").alias("n")).withColumn("rg", F.lit("all")))


def transition_table(bases: DataFrame) -> DataFrame:
    """Reference to base by mate, strand, nearest end and distance from it; share of the reference base's total, and damage.

    bases have mate, d5 and d3. damage is (f - r) / (1 - r) of the share f and the share r of the opposite change there.
    """
    keys = ["mate", "is_rev", "end", "dist"]
    rows = bases.withColumns({"end": F.when(F.col("d5") <= F.col("d3"), 5).otherwise(3), "dist": F.least("d5", "d3")}).groupBy(*keys, "ref", "base").agg(F.count("*").alias("n"))
    rows = rows.withColumn("_f", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "ref")))
    back = rows.select(*keys, F.col("ref").alias("base"), F.col("base").alias("ref"), F.col("_f").alias("_r"))
    f, r = F.col("_f"), F.coalesce("_r", F.lit(0.0))
    rows = rows.join(back, [*keys, "ref", "base"], "left")
    return rows.select(*keys, "ref", "base", "n", F.round(f, 6).alias("share"), F.when((F.col("ref") != F.col("base")) & (r < 1), F.round((f - r) / (1 - r), 6)).alias("damage"))


def damage_init(bases: DataFrame, min_data: int = 0, keep: int = 15) -> DataFrame:
    """First damage estimate by distance: (f - r) / (1 - r) of C to T against T to C, at least 1e-9.

    Distances from ``keep`` on are pooled, from the far end, until both bases have min_data; n tells how many are one. The
    pooling is done on the counts by distance, of which there are as many as a read is long.
    """
    rows = bases.groupBy("off").agg(
        *(F.count_if((F.col("ref") == a) & (F.col("base") == b)).alias(f"n{a}{b}") for a, b in ((1, 3), (3, 1))),
        *(F.count_if(F.col("ref") == a).alias(f"n{a}") for a in (1, 3)),
    )
    beyond = Window.orderBy(F.desc("off")).rowsBetween(Window.unboundedPreceding, 0)
    enough = (F.sum("n1").over(beyond) >= min_data) & (F.sum("n3").over(beyond) >= min_data)
    at = F.when(F.col("off") >= F.greatest(F.coalesce("_cut", F.lit(0)), F.lit(keep)), F.greatest(F.coalesce("_cut", F.lit(0)), F.lit(keep))).otherwise(F.col("off"))
    rows = rows.withColumn("_ok", enough).withColumn("_cut", F.max(F.when(F.col("_ok"), F.col("off"))).over(Window.partitionBy(F.lit(0))) if min_data else F.lit(1 << 30))
    rows = rows.groupBy(at.cast("long").alias("off")).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("n13", "n31", "n1", "n3")))
    f, r = F.col("n13") / F.col("n1"), F.col("n31") / F.col("n3")
    return rows.where("n1 > 0 AND n3 > 0").select("off", "n", F.round(F.greatest(F.lit(1e-9), (f - r) / (1 - r)), 9).alias("psi"))


def context_table(bases: DataFrame) -> DataFrame:
    """Quality by the base before in the read (column prev) and the base."""
    return bases.groupBy("qual", "prev", "base").agg(F.count("*").alias("n"))


def window_depth_stats(bases: DataFrame, size: int) -> DataFrame:
    """For each window of the genome: covered sites, mean depth over all its sites, share missing, sites of depth 2 or more."""
    sites = bases.groupBy(*KEY).agg(F.count("*").alias("depth"))
    return sites.groupBy("chrom", F.floor(F.col("site") / size).cast("long").alias("win")).agg(
        F.count("*").alias("n_sites"), F.round(F.sum("depth") / size, 6).alias("mean_depth"),
        F.round(1 - F.count("*") / size, 6).alias("missing"), F.count_if(F.col("depth") >= 2).alias("n_depth2"),
    )


def base_frequencies_window(bases: DataFrame, size: int) -> DataFrame:
    """Mean over sites of a site's base frequencies, by window."""
    sites = bases.groupBy(*KEY).agg(*_counts(), F.count("*").alias("depth"))
    return sites.groupBy("chrom", F.floor(F.col("site") / size).cast("long").alias("win")).agg(*(F.round(F.avg(F.col(f"n{b.lower()}") / F.col("depth")), 6).alias(f"f_{b.lower()}") for b in BASES))


def site_depth_cap(bases: DataFrame, most: int) -> DataFrame:
    """At most ``most`` bases of a site. Spark ranks within each task first, so a deep site sends that many from each at most."""
    return bases.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy("read_id", "qual", "base"))).where(F.col("_k") <= most).drop("_k")


def site_depth_filter(pile: DataFrame, low: int, high: int) -> DataFrame:
    return pile.where(F.col("depth").between(low, high))


def allelic_depth_table(pile: DataFrame) -> DataFrame:
    """Sites by their four counts, with the major allele and its depth; ties go to the earlier base."""
    top = F.greatest("na", "nc", "ng", "nt")
    major = F.array_position(F.array("na", "nc", "ng", "nt"), top) - 1
    return pile.groupBy("na", "nc", "ng", "nt").agg(F.count("*").alias("n")).withColumns({"major": major.cast("long"), "major_depth": top})


def site_sums(bases: DataFrame, *by: str) -> DataFrame:
    """The nine sums that give a site's ten genotype likelihoods: no list of bases is ever collected. N counts for nothing.

    What a base adds depends on its quality alone, so it is looked up; a quality beyond the table counts as its last.
    """
    at = F.least(F.greatest(F.col("qual"), F.lit(1)), F.lit(93)).cast("int")
    rows = bases.where("base < 4").withColumns({f"_{k}": F.element_at(F.array(*map(F.lit, t)), at) for k, t in zip(("miss", "one", "two"), quality_terms(), strict=True)})
    sums = [F.sum(F.when(F.col("base") == b, F.col(f"_{k}")).otherwise(0.0)).alias(f"s_{k}{b}") for k in ("one", "two") for b in range(4)]
    rms = [F.floor(F.sqrt(F.avg(F.col("mapq") * F.col("mapq")))).cast("long").alias("rms_mapq")] if "mapq" in bases.columns else []
    return rows.groupBy(*by, *KEY, "ref").agg(F.count("*").alias("depth"), F.sum("_miss").alias("s_miss"), *sums, *rms)


def genotype_likelihoods(bases: DataFrame, *by: str) -> DataFrame:
    """The columns by, chrom, site, ref, depth, logs (ten ln likelihoods) and gl (scaled to a greatest of 1); rms_mapq if bases have mapq."""
    rows = site_sums(bases, *by)
    rows = rows.select(*by, *KEY, "ref", "depth", *[c for c in rows.columns if c == "rms_mapq"], genotype_logs().alias("logs"))
    return rows.withColumn("gl", scaled_ten("logs"))


def haploid_likelihoods(bases: DataFrame, *by: str) -> DataFrame:
    """The columns by, chrom, site, ref, depth, logs (four ln likelihoods of a single allele) and gl."""
    rows = site_sums(bases, *by)
    logs = F.array(*(F.col("s_miss") + F.col(f"s_two{b}") for b in range(4)))
    rows = rows.select(*by, *KEY, "ref", "depth", *[c for c in rows.columns if c == "rms_mapq"], logs.alias("logs"))
    return rows.withColumn("gl", scaled_ten("logs", 4))


def call_mle(sites: DataFrame) -> DataFrame:
    """The likeliest genotype, the first of several, and its quality against the second."""
    each = [F.element_at("logs", i + 1) for i in range(10)]
    best = F.greatest(*each)
    at = F.array_position("logs", best)
    second = F.greatest(*(F.when(at == i + 1, F.lit(float("-inf"))).otherwise(x) for i, x in enumerate(each)))
    gq = (best - second) * 10 / F.ln(F.lit(10.0))
    return sites.select(*KEY, "ref", "depth", (at - 1).cast("long").alias("genotype"), F.round(gq, 3).alias("gq"))


def theta_prior(theta: float, freqs=(0.25, 0.25, 0.25, 0.25)) -> list[float]:
    from math import exp

    e = exp(-theta)
    raw = [freqs[a] * (e + freqs[a] * (1 - e)) if a == b else 2 * freqs[a] * freqs[b] * (1 - e) for a, b in GENOTYPES]
    return [x / sum(raw) for x in raw]


def posterior(sites: DataFrame, prior: list[float]) -> DataFrame:
    w = [F.element_at("gl", i + 1) * p for i, p in enumerate(prior)]
    return sites.withColumn("post", F.array(*(x / sum(w) for x in w)))


def phred(p: Column, most: int = 999) -> Column:
    """-10 log10 p, at most ``most``."""
    return F.least(F.lit(float(most)), F.round(-10 * F.log10(F.greatest(p, F.lit(1e-300))), 3))


def _rest(values: list[Column], best: Column) -> Column:
    """The sum of all but the first that is the best: 1 - best, without its rounding."""
    hit = [sum((F.when(x == best, 1).otherwise(0) for x in values[:i]), F.lit(0)) for i in range(len(values))]
    return sum(F.when((x == best) & (hit[i] == 0), 0.0).otherwise(x) for i, x in enumerate(values))


def call_bayes(sites: DataFrame, prior: list[float]) -> DataFrame:
    """The genotype of the greatest posterior, that, and the quality of its being right."""
    rows, each = posterior(sites, prior), [F.element_at("post", i + 1) for i in range(10)]
    best = F.greatest(*each)
    return rows.select(*KEY, (F.array_position("post", best) - 1).cast("long").alias("genotype"), F.round(best, 6).alias("prob"), phred(_rest(each, best)).alias("gq"))


def call_allele_presence(sites: DataFrame, prior: list[float]) -> DataFrame:
    """For each base the posterior probability that the genotype has it; the likeliest genotype and its quality."""
    rows, each = posterior(sites, prior), [F.element_at("post", i + 1) for i in range(10)]
    has = [sum(each[i] for i, g in enumerate(GENOTYPES) if b in g) for b in range(4)]
    best = F.greatest(*each)
    return rows.select(*KEY, *(F.round(p, 6).alias(f"p_{BASES[b].lower()}") for b, p in enumerate(has)), (F.array_position("post", best) - 1).cast("long").alias("genotype"), phred(_rest(each, best)).alias("gq"))


def call_columns(sites: DataFrame) -> DataFrame:
    """gl, log10 likelihoods, and pl, phred-scaled ones, of the ten genotypes against the likeliest, as a call's text."""
    logs = [F.round(F.log10(F.element_at("gl", i + 1)), 4) + 0.0 for i in range(10)]
    text = lambda values, kind: F.concat_ws(",", *(x.cast(kind).cast("string") for x in values))
    return sites.select(*KEY, text(logs, "decimal(12,4)").alias("gl"), text([F.round(-10 * x) for x in logs], "long").alias("pl"))


def call_majority(pile: DataFrame) -> DataFrame:
    """The most frequent base; ties are broken by a number drawn from the site."""
    ranks = F.array(*(F.struct((-F.col(f"n{b.lower()}")).alias("m"), F.pmod(F.col("site") * 7 + k * 13, F.lit(11)).alias("h"), F.lit(k).alias("b")) for k, b in enumerate(BASES)))
    top = F.element_at(F.array_sort(ranks), 1)
    return pile.select(*KEY, top["b"].cast("long").alias("call"), (-top["m"]).alias("ad"))


def theta_surface(sites: DataFrame, size: int, steps: int = 5) -> DataFrame:
    """Log likelihood of each window at log10(theta) in [-5, -1] in equal steps."""
    grid = [-5 + 4 * i / (steps - 1) for i in range(steps)]
    dot = lambda p: sum(F.element_at("gl", i + 1) * x for i, x in enumerate(p))
    sums = [F.sum(F.ln(dot(theta_prior(10**x)))).alias(f"_{i}") for i, x in enumerate(grid)]
    rows = sites.groupBy("chrom", F.floor(F.col("site") / size).cast("long").alias("win")).agg(*sums)
    each = F.array(*(F.struct(F.lit(round(x, 6)).alias("log10_theta"), F.round(f"_{i}", 3).alias("ll")) for i, x in enumerate(grid)))
    return rows.select("chrom", "win", F.inline(each))


def mutation_load(sites: DataFrame, iterations: int = 3) -> DataFrame:
    """EM for the weights of four classes against the preferred base: homozygous for it, heterozygous with it, homozygous
    for another, heterozygous for others. Each step is one aggregate of four sums."""
    kinds = lambda r: [0 if a == b == r else 1 if r in (a, b) else 2 if a == b else 3 for a, b in GENOTYPES]
    share = (1.0, 3.0, 3.0, 3.0)
    sums = []
    for c in range(4):
        pick = F.lit(0.0)
        for r in range(4):
            at = [i + 1 for i, k in enumerate(kinds(r)) if k == c]
            pick = F.when(F.col("ref") == r, sum(F.element_at("gl", i) for i in at) / share[c]).otherwise(pick)
        sums.append(pick.alias(f"c{c}"))
    rows = sites.select(*sums).persist()
    p = [0.25] * 4
    try:
        for _ in range(iterations):
            total = sum(F.col(f"c{c}") * p[c] for c in range(4))
            got = rows.agg(*(F.sum(F.col(f"c{c}") * p[c] / total).alias(f"s{c}") for c in range(4))).first()
            whole = sum(got) or 1.0
            p = [x / whole for x in got]
    finally:
        rows.unpersist()
    return sites.sparkSession.createDataFrame([(c, round(x, 6)) for c, x in enumerate(p)], "class int, weight double")


def psmc_blocks(sites: DataFrame, prior: list[float], block: int = 100, confidence: float = 0.99) -> DataFrame:
    """Blocks as T, K or N by the summed log probability that their sites are homozygous."""
    hom = sum(F.element_at("post", i + 1) for i, (a, b) in enumerate(GENOTYPES) if a == b)
    rows = posterior(sites, prior).groupBy("chrom", F.floor(F.col("site") / block).cast("long").alias("block")).agg(F.sum(F.ln(hom)).alias("s"))
    from math import log

    code = F.when(F.col("s") > log(confidence), "T").when(F.col("s") < log(1 - confidence), "K").otherwise("N")
    return rows.select("chrom", "block", code.alias("code"))


def mask(pile: DataFrame, kind: str, min_depth: int = 2) -> DataFrame:
    """Intervals of sites that are deep enough and invariant, variant, or not the reference."""
    test = {"invariant": "n_alleles = 1", "variant": "n_alleles > 1", "nonref": "alt_depth > 0"}[kind]
    return sites_to_intervals(pile.where(F.col("depth") >= min_depth).where(test))


def mask_depth(pile: DataFrame, genome: int, chroms: DataFrame, low: int = 2, high: int = 1_000_000) -> DataFrame:
    """Intervals of all places, uncovered ones too, whose depth is out of range."""
    good = sites_to_intervals(pile.where(F.col("depth").between(low, high)))
    return regions_complement(good, genome, chroms)


def sites_x_alleles(bases: DataFrame, alleles: DataFrame) -> DataFrame:
    """Reads by what they show at known sites: ref, alt, both or other."""
    rows = bases.join(alleles, KEY).groupBy("read_id").agg(F.max((F.col("base") == F.col("known_ref")).cast("int")).alias("r"), F.max((F.col("base") == F.col("known_alt")).cast("int")).alias("a"))
    kind = F.when((F.col("r") == 1) & (F.col("a") == 1), "both").when(F.col("r") == 1, "ref").when(F.col("a") == 1, "alt").otherwise("other")
    return rows.select("read_id", kind.alias("class"))
