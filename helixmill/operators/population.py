"""Operators on genotype likelihoods and calls by locus and sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.operators.binned import before_bins, in_bin, joined, previous, with_bin
from helixmill.operators.sized import few

LOCUS = ["chrom", "pos"]


def likelihoods(gl: DataFrame) -> DataFrame:
    """l0, l1, l2 from phred-scaled likelihoods, normalised to a sum of 1."""
    raw = {f"_{k}": F.pow(F.lit(10.0), -F.col(f"pl{k}") / 10) for k in range(3)}
    total = F.col("_0") + F.col("_1") + F.col("_2")
    return gl.withColumns(raw).withColumns({f"l{k}": F.col(f"_{k}") / total for k in range(3)}).drop(*raw)


def locus_filter(gl: DataFrame, min_depth: int = 0, min_samples: int = 1, min_maf: float = 0.0, max_missing: float = 1.0, samples: int | None = None) -> DataFrame:
    """Drops samples below a depth, then loci with too few samples, too many of ``samples`` missing, or too rare a minor allele.

    If gl has alt, loci with more than one alternative allele are dropped as well.
    """
    kept = gl.where(F.col("dp") >= min_depth)
    f = F.sum("gt") / (2 * F.count("*"))
    loci = kept.groupBy(*LOCUS).agg(F.count("*").alias("_n"), F.least(f, 1 - f).alias("_maf"), *([F.max(F.col("alt").contains(",")).alias("_many")] if "alt" in gl.columns else []))
    loci = loci.where((F.col("_n") >= min_samples) & (F.col("_maf") >= min_maf))
    if samples:
        loci = loci.where(1 - F.col("_n") / samples <= max_missing)
    if "alt" in gl.columns:
        loci = loci.where(~F.col("_many"))
    return kept.join(loci.select(*LOCUS), LOCUS, "left_semi")


def call_filter(gl: DataFrame, min_depth: int = 0, min_quality: int = 0) -> DataFrame:
    """Calls below a depth, or whose second-best genotype is too likely, become missing (null)."""
    second = F.element_at(F.array_sort(F.array("pl0", "pl1", "pl2")), 2)
    good = (F.col("dp") >= min_depth) & (second >= min_quality)
    return gl.withColumns({"gq": second, "gt": F.when(good, F.col("gt"))})


def sample_pairs(gl: DataFrame) -> DataFrame:
    """Every two samples of a locus, the smaller first, with both calls."""
    by = gl.groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("sample", "gt"))).alias("_s"))  # as many as there are samples
    pairs = by.select(*LOCUS, F.explode("_s").alias("a"), "_s").select(*LOCUS, "a", F.explode("_s").alias("b")).where("a.sample < b.sample")
    return pairs.select(*LOCUS, F.col("a.sample").alias("s1"), F.col("b.sample").alias("s2"), F.col("a.gt").alias("g1"), F.col("b.gt").alias("g2"))


def f2(gl: DataFrame) -> DataFrame:
    """Share of loci at which the calls of two samples differ, for every pair of samples that share a locus."""
    pairs = sample_pairs(gl).groupBy("s1", "s2")
    return pairs.agg(F.count("*").alias("n"), F.round(F.avg((F.col("g1") != F.col("g2")).cast("double")), 6).alias("f2"))


def f2_populations(gl: DataFrame) -> DataFrame:
    """Mean of the samples' f2 within and between populations; two samples without a common locus count as 0.

    How many pairs there are follows from the populations' sizes, so only pairs with a common locus are rows.
    """
    samples = gl.select("sample", "pop").distinct()
    one, two = (samples.select(F.col("sample").alias(f"s{k}"), F.col("pop").alias(f"p{k}")) for k in (1, 2))
    rows = f2(gl).select("s1", "s2", "f2").join(one, "s1").join(two, "s2")
    sums = rows.groupBy(F.least("p1", "p2").alias("pop1"), F.greatest("p1", "p2").alias("pop2")).agg(F.sum("f2").alias("_f2"))
    sizes = samples.groupBy("pop").agg(F.count("*").alias("n"))
    a, b = (few(sizes).select(F.col("pop").alias(f"pop{k}"), F.col("n").alias(f"_n{k}")) for k in (1, 2))
    n = F.when(F.col("pop1") == F.col("pop2"), F.expr("_n1 * (_n1 - 1) div 2")).otherwise(F.expr("_n1 * _n2"))
    pairs = a.join(b, F.col("pop1") <= F.col("pop2")).withColumn("n_pairs", n).where("n_pairs > 0")  # of populations
    return pairs.join(sums, ["pop1", "pop2"], "left").select("pop1", "pop2", "n_pairs", F.round(F.coalesce("_f2", F.lit(0.0)) / F.col("n_pairs"), 6).alias("f2"))


def thin_loci(gl: DataFrame, distance: int) -> DataFrame:
    """Loci of a chromosome at least ``distance`` from the last one kept, the first one on.

    Where two neighbours are that far apart the second is kept whatever came before, so loci are cut there; a part, at most
    a chromosome's distinct places, is walked by jumps to the first place that is far enough.
    """
    import numpy as np
    import pandas as pd

    loci = previous(gl.select(*LOCUS).distinct(), ["chrom"], ["pos"], F.col("pos"))
    loci = with_bin(loci.withColumn("_head", F.when(F.col("_before").isNull() | (F.col("pos") - F.col("_before") >= distance), F.col("pos"))), "pos")
    carry = loci.groupBy("chrom", "_bin").agg(F.max("_head").alias("_last"))
    carry = carry.select("chrom", "_bin", F.max("_last").over(before_bins("chrom")).alias("_carry"))
    own = F.max("_head").over(in_bin("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    parts = joined(loci, carry, "chrom").select("chrom", F.coalesce(own, F.col("_carry")).alias("_part"), "pos")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pos, kept, i = np.sort(rows["pos"].to_numpy()), [], 0
        while i < len(pos):
            kept.append(pos[i])
            i = int(np.searchsorted(pos, pos[i] + distance))
        return pd.DataFrame({"chrom": key[0], "pos": kept})

    return parts.groupBy("chrom", "_part").applyInPandas(walk, "chrom long, pos long")


def to_genfile(gl: DataFrame, samples: int, distance: int, most: int, min_depth: int = 1) -> DataFrame:
    """A line of true genotypes for each locus: those of the deepest samples at thinned loci, NA for all others.

    Only loci with a sample of the least depth are thinned; a locus without one is a line of NA.
    """
    good = gl.where(F.col("dp") >= min_depth)
    top = topk_samples_by_depth(good, most).join(thin_loci(good, distance), LOCUS, "left_semi").select(*LOCUS, "sample", F.lit(True).alias("_kept"))
    cell = F.when(F.col("_kept"), F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.col("gt").cast("int") + 1)).otherwise("NA")
    rows = gl.join(top, [*LOCUS, "sample"], "left").groupBy(*LOCUS).agg(F.map_from_entries(F.collect_list(F.struct("sample", cell.alias("v")))).alias("_m"))
    return rows.select(*LOCUS, F.concat_ws(" ", *(F.coalesce(F.element_at("_m", F.lit(s).cast("long")), F.lit("NA")) for s in range(samples))).alias("line"))


def pop_genotype_counts(gl: DataFrame) -> DataFrame:
    return gl.groupBy(*LOCUS, "pop").agg(F.count("*").alias("n"), (2 * F.count("*") - F.sum("gt")).alias("n_a"), F.count_if(F.col("gt") == 1).alias("n_ab"))


def hwe_test(counts: DataFrame) -> DataFrame:
    """Exact test of Hardy-Weinberg proportions for each distinct (n, n_a, n_ab), joined back: P(as few hets), P(as many)."""
    cases = counts.select("n", "n_a", "n_ab").distinct()
    n, a, b = F.col("n"), F.col("n_a"), 2 * F.col("n") - F.col("n_a")
    top = F.least(a, b)
    ln = lambda k: F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda s, i: s + F.ln(F.greatest(i, F.lit(1))))
    base = ln(n) + ln(a) + ln(b) - ln(2 * n)
    one = lambda h: h * F.ln(F.lit(2.0)) + base - ln(((a - h) / 2).cast("long")) - ln(h) - ln(((b - h) / 2).cast("long"))
    hets = F.filter(F.sequence(F.lit(0).cast("long"), top), lambda h: F.pmod(h - a, F.lit(2)) == 0)
    rows = cases.withColumn("_p", F.transform(hets, lambda h: F.struct(h.alias("h"), F.exp(one(h)).alias("p"))))
    add = lambda keep: F.aggregate(F.filter("_p", keep), F.lit(0.0), lambda s, x: s + x["p"])
    rows = rows.select("n", "n_a", "n_ab", F.round(add(lambda x: x["h"] <= F.col("n_ab")), 6).alias("p_less"), F.round(add(lambda x: x["h"] >= F.col("n_ab")), 6).alias("p_more"))
    return counts.join(rows, ["n", "n_a", "n_ab"])


def _het_distribution() -> Column:
    """P(h heterozygotes) for h from 0 to the most that n and n_a allow, under Hardy-Weinberg proportions; 0 at the wrong parity."""
    n, a, b = F.col("n"), F.col("n_a"), 2 * F.col("n") - F.col("n_a")
    ln = lambda k: F.aggregate(F.sequence(F.lit(0).cast("long"), k), F.lit(0.0), lambda s, i: s + F.ln(F.greatest(i, F.lit(1))))
    base = ln(n) + ln(a) + ln(b) - ln(2 * n)
    one = lambda h: F.exp(h * F.ln(F.lit(2.0)) + base - ln(((a - h) / 2).cast("long")) - ln(h) - ln(((b - h) / 2).cast("long")))
    return F.transform(F.sequence(F.lit(0).cast("long"), F.least(a, b)), lambda h: F.when(F.pmod(h - a, F.lit(2)) == 0, one(h)).otherwise(0.0))


def _convolved(a: Column, b: Column) -> Column:
    """The distribution of a sum. Each of its parts can be of one parity only, so terms of the other are zero."""
    last = lambda x: F.size(x) - 1
    at = lambda k: F.sequence(F.greatest(F.lit(0), k - last(b)), F.least(k, last(a)))
    return F.transform(F.sequence(F.lit(0), last(a) + last(b)), lambda k: F.aggregate(at(k), F.lit(0.0), lambda s, i: s + F.get(a, i) * F.get(b, k - i)))


def hwe_populations(counts: DataFrame) -> DataFrame:
    """The exact test over the populations of a locus: the chance of as few, and of as many, heterozygotes in all of them together.

    counts: chrom, pos, pop, n, n_a, n_ab. Populations are independent, so the number of heterozygotes is a sum, whose
    distribution is the convolution of theirs. It is made once for each different set of (n, n_a), not for each locus.
    Populations without samples don't count; a locus without any has no row.
    """
    loci = counts.where("n > 0").groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("n", "n_a"))).alias("_set"), F.count("*").alias("n_pops"), F.sum("n").alias("n"), F.sum("n_ab").alias("n_ab"))
    cases = loci.select("_set").distinct().withColumn("_k", F.monotonically_increasing_id())
    parts = cases.select("_k", F.posexplode("_set")).select("_k", "pos", "col.n", "col.n_a").withColumn("_p", _het_distribution())
    whole = parts.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("pos", "_p"))).alias("_l"))
    whole = whole.withColumn("_p", F.aggregate(F.transform("_l", lambda x: x["_p"]), F.array(F.lit(1.0)), _convolved))
    rows = loci.join(cases, "_set").join(whole.select("_k", "_p"), "_k")
    add = lambda low, high: F.aggregate(F.slice("_p", low + 1, high - low + 1), F.lit(0.0), lambda s, x: s + x)
    last, seen = F.size("_p") - 1, F.col("n_ab").cast("int")
    return rows.select(*LOCUS, "n_pops", "n", "n_ab", F.round(add(F.lit(0), seen), 6).alias("p_less"), F.round(add(seen, last), 6).alias("p_more"))


def f_table(gl: DataFrame, pops: list[int]) -> DataFrame:
    """minor/total of each population at each locus."""
    cells = gl.groupBy(*LOCUS).pivot("pop", pops).agg(F.concat_ws("/", F.sum("gt").cast("string"), (2 * F.count("gt")).cast("string")))
    return cells.select(*LOCUS, *(F.when(F.col(str(p)).contains("/"), F.col(str(p))).otherwise(F.lit("0/0")).alias(f"pop{p}") for p in pops))


def allele_freq_surface(gl: DataFrame, points: int = 5) -> DataFrame:
    """Log likelihood of an allele frequency on a grid, by population."""
    rows = likelihoods(gl).groupBy("pop")
    grid = [(i + 0.5) / points for i in range(points)]
    dot = lambda f: F.ln(F.col("l0") * (1 - f) ** 2 + F.col("l1") * 2 * f * (1 - f) + F.col("l2") * f * f)
    sums = rows.agg(*(F.sum(dot(f)).alias(f"_{i}") for i, f in enumerate(grid)))
    return sums.select("pop", F.inline(F.array(*(F.struct(F.lit(round(f, 6)).alias("freq"), F.round(f"_{i}", 3).alias("ll")) for i, f in enumerate(grid)))))


def allele_freq_hw(gl: DataFrame, iterations: int = 3) -> DataFrame:
    """EM for the allele frequency of each locus and population under Hardy-Weinberg proportions."""
    rows = likelihoods(gl).groupBy(*LOCUS, "pop").agg(F.array_sort(F.collect_list(F.struct("sample", "l0", "l1", "l2"))).alias("_s"))  # one locus's samples

    def step(f):
        def dose(s):
            w0, w1, w2 = s["l0"] * (1 - f) * (1 - f), s["l1"] * 2 * f * (1 - f), s["l2"] * f * f
            return (w1 + 2 * w2) / (w0 + w1 + w2)

        return F.aggregate("_s", F.lit(0.0), lambda a, s: a + dose(s)) / (2 * F.size("_s"))

    rows = rows.withColumn("_f", F.lit(0.5))
    for k in range(iterations):
        rows = rows.withColumn("_f" if k + 1 < iterations else "freq", step(F.col("_f")))
    return rows.select(*LOCUS, "pop", F.round("freq", 6).alias("freq"))


def het_imbalance(gl: DataFrame, thresholds: list[int]) -> DataFrame:
    """Heterozygous calls by depth of the reference and of the alternative (column ad), for every threshold their quality reaches."""
    gq = F.least(F.when(F.col("pl0") > 0, F.col("pl0")).otherwise(999), F.when(F.col("pl2") > 0, F.col("pl2")).otherwise(999))
    t = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda x: x <= gq))
    rows = gl.where("gt = 1").select((F.col("dp") - F.col("ad")).alias("ref_depth"), F.col("ad").alias("alt_depth"), t.alias("threshold"))
    return rows.groupBy("threshold", "ref_depth", "alt_depth").agg(F.count("*").alias("n"))


def invariant_intervals(gl: DataFrame) -> DataFrame:
    """Runs of neighbouring loci at which all samples are homozygous for one allele: those with one last variant locus before."""
    loci = gl.groupBy(*LOCUS).agg(((F.min("gt") == F.max("gt")) & (F.min("gt") != 1)).alias("_inv"))
    loci = with_bin(loci, "pos").withColumn("_var", F.when(~F.col("_inv"), F.col("pos")))
    carry = loci.groupBy("chrom", "_bin").agg(F.max("_var").alias("_last"))
    carry = carry.select("chrom", "_bin", F.max("_last").over(before_bins("chrom")).alias("_carry"))
    before = F.max("_var").over(in_bin("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = joined(loci, carry, "chrom").withColumn("_run", F.coalesce(before, F.col("_carry"), F.lit(-1)))
    return rows.where("_inv").groupBy("chrom", "_run").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("stop"), F.count("*").alias("n")).drop("_run")


def topk_samples_by_depth(gl: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*LOCUS).orderBy(F.desc("dp"), "sample")
    return gl.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*LOCUS, "sample", "dp", "rank")


def to_beagle(gl: DataFrame, samples: int) -> DataFrame:
    """Marker and three likelihoods for each sample, a third each where it is missing."""
    cell = F.concat_ws(" ", *(F.format_number(F.round(f"l{k}", 4), 4) for k in range(3)))
    rows = likelihoods(gl).groupBy(*LOCUS).agg(F.map_from_entries(F.collect_list(F.struct("sample", cell.alias("v")))).alias("_m"))
    cells = [F.coalesce(F.element_at("_m", F.lit(s).cast("long")), F.lit("0.3333 0.3333 0.3333")) for s in range(samples)]
    return rows.select(F.concat_ws("_", *LOCUS).alias("marker"), F.concat_ws(" ", *cells).alias("line"))


def to_geno(gl: DataFrame, samples: int) -> DataFrame:
    """A digit for each sample: copies of the reference, 9 if missing."""
    rows = gl.groupBy(*LOCUS).agg(F.map_from_entries(F.collect_list(F.struct("sample", "gt"))).alias("_m"))
    return rows.select(*LOCUS, F.concat(*(F.coalesce((2 - F.element_at("_m", F.lit(s).cast("long"))).cast("string"), F.lit("9")) for s in range(samples))).alias("line"))


def allele_dosage(gl: DataFrame) -> DataFrame:
    return likelihoods(gl).select(*LOCUS, "sample", F.round(F.col("l1") + 2 * F.col("l2"), 6).alias("dosage"))


def ancestral_alleles(gl: DataFrame, most_minor: int, least_total: int) -> DataFrame:
    """The major allele, 0 or 1, where the minor one is rare enough and the total great enough; else -1."""
    rows = gl.groupBy(*LOCUS).agg(F.sum("gt").alias("alt"), (2 * F.count("*")).alias("total"))
    minor = F.least(F.col("alt"), F.col("total") - F.col("alt"))
    call = F.when((minor <= most_minor) & (F.col("total") >= least_total), F.when(F.col("alt") * 2 > F.col("total"), 1).otherwise(0)).otherwise(-1)
    return rows.select(*LOCUS, "alt", "total", call.alias("ancestral"))


def ancestral_lines(calls: DataFrame, chroms: DataFrame, genome: int, width: int = 60) -> DataFrame:
    """The ancestral letter of every place of each chromosome, N where there is none, in lines: chrom, line, letters.

    calls: chrom, pos (from 1), ancestral (0 reference, 1 alternative, else none), ref, alt letters. Only lines with a call are looked up.
    """
    letter = F.when(F.col("ancestral") == 0, F.col("ref")).when(F.col("ancestral") == 1, F.col("alt")).otherwise("N")
    at = F.col("pos") - 1
    rows = calls.where(at.between(0, genome - 1)).groupBy("chrom", F.floor(at / width).cast("long").alias("line")).agg(F.map_from_entries(F.collect_list(F.struct((at % width).alias("k"), letter.alias("v")))).alias("_m"))
    every = chroms.select("chrom", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((genome - 1) // width).cast("long"))).alias("line"))
    size = F.least(F.lit(width), F.lit(genome) - F.col("line") * width)
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda k: F.coalesce(F.element_at("_m", k), F.lit("N"))), "")
    return every.join(rows, ["chrom", "line"], "left").select("chrom", "line", F.coalesce(text, F.repeat(F.lit("N"), size.cast("int"))).alias("letters"))


def compare_calls(a: DataFrame, b: DataFrame, call: str = "call", missing: str = "-") -> DataFrame:
    """Counts of each pair of calls of two sets at the same locus and sample.

    A call is a base (haploid) or two (diploid), so there are fifteen with the missing one, which a null or no row is.
    """
    one, two = (x.select(*LOCUS, "sample", F.col(call).alias(f"g{k}")) for k, x in ((1, a), (2, b)))
    both = one.join(two, [*LOCUS, "sample"], "full")
    return both.groupBy(F.coalesce("g1", F.lit(missing)).alias("g1"), F.coalesce("g2", F.lit(missing)).alias("g2")).agg(F.count("*").alias("n"))


def allele_freq_mixed(gl: DataFrame, iterations: int = 3) -> DataFrame:
    """EM for the allele frequency of each locus and population where samples are haploid or diploid (column ploidy).

    A haploid sample's likelihoods are those of its two alleles, l0 and l2; only their ratio counts, so the greater is 1 and
    neither is lost where both are far below l1.
    """
    two = {f"l{k}": F.when(F.col("ploidy") == 1, F.pow(F.lit(10.0), (F.least("pl0", "pl2") - F.col(f"pl{k}")) / 10)).otherwise(F.col(f"l{k}")) for k in (0, 2)}
    rows = likelihoods(gl).withColumns(two).groupBy(*LOCUS, "pop").agg(F.array_sort(F.collect_list(F.struct("sample", "ploidy", "l0", "l1", "l2"))).alias("_s"), F.sum("ploidy").alias("_n"))

    def step(f: Column) -> Column:
        def dose(s: Column) -> Column:
            w0, w1, w2 = s["l0"] * (1 - f) * (1 - f), s["l1"] * 2 * f * (1 - f), s["l2"] * f * f
            h0, h1 = s["l0"] * (1 - f), s["l2"] * f
            return F.when(s["ploidy"] == 1, h1 / (h0 + h1)).otherwise((w1 + 2 * w2) / (w0 + w1 + w2))

        return F.aggregate("_s", F.lit(0.0), lambda a, s: a + dose(s)) / F.col("_n")

    rows = rows.withColumn("_f0", F.lit(0.5))
    for k in range(iterations):
        rows = rows.withColumn(f"_f{k + 1}", step(F.col(f"_f{k}")))
    return rows.select(*LOCUS, "pop", F.col("_n").cast("long").alias("n_alleles"), F.round(f"_f{iterations}", 6).alias("freq"))
