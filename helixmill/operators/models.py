"""Models fitted by sites or by loci, and rows for other programs.

Fits over all sites are loops of one aggregate each over a cached table; fits by locus fold over the locus's samples.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators.population import LOCUS, likelihoods

SITE = ["chrom", "site"]


def genotype_mixture(sites: DataFrame, iterations: int = 3) -> DataFrame:
    """EM for the ten genotype frequencies without constraint; each step is one aggregate of ten sums."""
    rows, p = sites.select("gl").persist(), [0.1] * 10
    try:
        for _ in range(iterations):
            w = [F.element_at("gl", i + 1) * p[i] for i in range(10)]
            got = rows.agg(*(F.sum(x / sum(w)).alias(f"s{i}") for i, x in enumerate(w))).first()
            whole = sum(v or 0.0 for v in got) or 1.0
            p = [(v or 0.0) / whole for v in got]
    finally:
        rows.unpersist()
    return sites.sparkSession.createDataFrame([(i, round(x, 6)) for i, x in enumerate(p)], "genotype int, freq double")


def substitution_table(mu: float, theta_r: float, theta_g: float) -> np.ndarray:
    """P(genotype | reference base), 4 x 10, of the two-step substitution model with transition share mu."""
    z = (1 - mu) / 2
    rate = np.array([[-1, z, mu, z], [z, -1, z, mu], [mu, z, -1, z], [z, mu, z, -1]])
    values, vectors = np.linalg.eigh(rate)
    p_r, p_g = ((vectors * np.exp(t * values)) @ vectors.T for t in (theta_r, theta_g))
    out = np.stack([(1 if k == m else 2) * (p_r * (p_g[k] * p_g[m])[:, None]).sum(0) for k, m in GENOTYPES], axis=1)
    return out / out.sum(1, keepdims=True)


def hky85_posterior(sites: DataFrame, mu: float, theta_r: float, theta_g: float) -> DataFrame:
    """Posterior of each genotype and P(heterozygous) under fixed parameters."""
    table = substitution_table(mu, theta_r, theta_g).tolist()
    prior = F.element_at(F.array(*(F.array(*map(F.lit, row)) for row in table)), (F.col("ref") + 1).cast("int"))
    w = [F.element_at("gl", i + 1) * F.element_at("_pi", i + 1) for i in range(10)]
    rows = sites.withColumn("_pi", prior).withColumn("post", F.array(*(x / sum(w) for x in w)))
    het = sum(F.element_at("post", i + 1) for i, (a, b) in enumerate(GENOTYPES) if a != b)
    return rows.select(*SITE, "ref", (F.array_position("post", F.array_max("post")) - 1).cast("long").alias("genotype"), F.round(het, 6).alias("p_het"))


def prior_mstep(sums: np.ndarray, at: np.ndarray, least: float = 1e-4) -> np.ndarray:
    """(mu, theta_r, theta_g) that make 4 x 10 sums of genotype posteriors by reference most likely: a climb in logit space from at."""
    logit, back = lambda x: np.log(x / (1 - x)), lambda y: 1 / (1 + np.exp(-y))
    y, step = logit(np.asarray(at, float)), 1.0
    score = lambda v: float((sums * np.log(np.maximum(substitution_table(*back(v)), 1e-300))).sum())
    best = score(y)
    while step > least:
        tries = [y + s * step * np.eye(3)[k] for k in range(3) for s in (-1, 1)]
        scores = [score(v) for v in tries]
        if max(scores) > best:
            best, y = max(scores), tries[int(np.argmax(scores))]
        else:
            step /= 2
    return back(y)


def hky85(sites: DataFrame, iterations: int = 200, min_gain: float = 1e-6) -> DataFrame:
    """EM for (mu, theta_r, theta_g), until the log likelihood rises by less than min_gain: forty posterior sums a step.

    A row for each step: the ll of the parameters that it began with, and those at the end.
    """
    rows, at, out = sites.select("ref", "gl").where("ref BETWEEN 0 AND 3").persist(), np.array([0.5, 1e-3, 1e-4]), []
    try:
        for t in range(iterations):
            table = substitution_table(*at).tolist()
            prior = F.element_at(F.array(*(F.array(*map(F.lit, row)) for row in table)), (F.col("ref") + 1).cast("int"))
            w = rows.withColumn("w", F.zip_with("gl", prior, lambda g, p: g * p)).withColumn("t", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
            got = w.groupBy("ref").agg(F.sum(F.ln("t")).alias("ll"), *(F.sum(F.element_at("w", i + 1) / F.col("t")).alias(f"s{i}") for i in range(10))).collect()  # four rows
            sums = np.zeros((4, 10))
            for r in got:
                sums[r["ref"]] = [r[f"s{i}"] for i in range(10)]
            ll = float(sum(r["ll"] for r in got))
            if out and ll - out[-1][1] < min_gain:
                break
            at = prior_mstep(sums, at)
            out.append((t, ll, *map(float, at)))
    finally:
        rows.unpersist()
    return sites.sparkSession.createDataFrame(out, "step int, ll double, mu double, theta_r double, theta_g double")


def _samples(gl: DataFrame) -> DataFrame:
    """The likelihoods of a locus's samples, in order, by population: as many as there are samples."""
    return likelihoods(gl).groupBy(*LOCUS, "pop").agg(F.array_sort(F.collect_list(F.struct("sample", "l0", "l1", "l2"))).alias("_s"))


def saf(gl: DataFrame) -> DataFrame:
    """ln likelihood of each count of alternative alleles by locus and population, greatest 0: a fold over samples, each
    step a convolution with (l0, 2 l1, l2) scaled by its greatest value, then a division by the binomial coefficient."""

    def add(h: Column, s: Column) -> Column:
        at = lambda j: F.when(j >= 0, F.coalesce(F.get(h, F.greatest(j, F.lit(0))), F.lit(0.0))).otherwise(0.0)
        out = F.transform(F.sequence(F.lit(0), F.size(h) + 1), lambda j: s["l0"] * at(j) + 2 * s["l1"] * at(j - 1) + s["l2"] * at(j - 2))
        top = F.transform(F.array(out), lambda o: F.struct(o.alias("o"), F.array_max(o).alias("m")))  # binds both: worked out once
        return F.get(F.transform(top, lambda t: F.transform(t["o"], lambda x: x / t["m"])), F.lit(0))

    lnfact = F.expr("aggregate(sequence(1, 2 * size(_s)), array(CAST(0 AS DOUBLE)), (a, i) -> concat(a, array(element_at(a, -1) + ln(i))))")
    rows = _samples(gl).withColumns({"_h": F.aggregate("_s", F.array(F.lit(1.0)), add), "_f": lnfact})
    logs = F.transform("_h", lambda x, j: F.ln(x) + F.get("_f", j) + F.get("_f", F.size("_h") - 1 - j) - F.get("_f", F.size("_h") - 1))
    bound = F.transform(F.array(logs), lambda o: F.struct(o.alias("o"), F.array_max(o).alias("m")))
    return rows.select(*LOCUS, "pop", F.get(F.transform(bound, lambda t: F.transform(t["o"], lambda x: F.round(x - t["m"], 6))), F.lit(0)).alias("saf"))


def allele_counts_ml(safs: DataFrame) -> DataFrame:
    """The likeliest count, the least of several, and the number of alleles seen."""
    return safs.select(*LOCUS, "pop", (F.array_position("saf", F.array_max("saf")) - 1).cast("long").alias("n_alt"), (F.size("saf") - 1).cast("long").alias("n_total"))


def genotype_frequencies(gl: DataFrame, iterations: int = 3) -> DataFrame:
    """EM for the three genotype frequencies of each locus and population, without Hardy-Weinberg proportions."""
    fields = [f"p{k}" for k in range(3)]

    def step(p: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            w = [s[f"l{k}"] * p[f"p{k}"] for k in range(3)]
            return F.struct(*((acc[c] + w[k] / (w[0] + w[1] + w[2])).alias(c) for k, c in enumerate(fields)))

        zero = F.struct(*(F.lit(0.0).alias(c) for c in fields))
        return F.aggregate("_s", zero, add, lambda acc: F.struct(*((acc[c] / F.size("_s")).alias(c) for c in fields)))

    rows = _samples(gl).withColumn("_p0", F.struct(*(F.lit(1 / 3).alias(c) for c in fields)))
    for t in range(iterations):
        rows = rows.withColumn(f"_p{t + 1}", step(F.col(f"_p{t}")))
    p = F.col(f"_p{iterations}")
    return rows.select(*LOCUS, "pop", *(F.round(p[f"p{k}"], 6).alias(f"f{k}") for k in range(3)))


def frequency_posterior(gl: DataFrame, points: int = 21, alpha: float = 0.7) -> DataFrame:
    """Posterior weights of the allele frequency at the middles of equal steps, under Hardy-Weinberg and a beta prior."""
    grid = F.array(*(F.lit((i + 0.5) / points) for i in range(points)))

    def ll(f: Column) -> Column:
        one = lambda s: F.ln(s["l0"] * (1 - f) * (1 - f) + s["l1"] * 2 * f * (1 - f) + s["l2"] * f * f)
        return F.aggregate("_s", (alpha - 1) * F.ln(f * (1 - f)), lambda a, s: a + one(s))

    def bound(values: Column, total: Column) -> Column:
        """values and a number of all of them, which is worked out once."""
        return F.transform(F.array(values), lambda v: F.struct(v.alias("v"), total(v).alias("t")))

    weights = F.get(F.transform(bound(F.transform(grid, ll), F.array_max), lambda b: F.transform(b["v"], lambda x: F.exp(x - b["t"]))), F.lit(0))
    whole = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    post = F.get(F.transform(bound(weights, whole), lambda b: F.transform(b["v"], lambda x: x / b["t"])), F.lit(0))
    return _samples(gl).select(*LOCUS, "pop", post.alias("post"))


def allele_freq_bayes(post: DataFrame, interval: float = 0.9) -> DataFrame:
    """The likeliest grid point and the ends of the central credible interval."""
    n = F.size("post")
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    tail = (1 - interval) / 2

    def add(acc, x):
        c = acc["c"] + x
        return F.struct(c.alias("c"), (acc["a"] + (c < tail).cast("int")).alias("a"), (acc["b"] + (c < 1 - tail).cast("int")).alias("b"))

    rows = post.withColumn("_e", F.aggregate("post", start, add))
    at = lambda i: F.round((i + 0.5) / n, 6)
    best = F.array_position("post", F.array_max("post")) - 1
    return rows.select(*LOCUS, "pop", at(best).alias("map"), at(F.col("_e")["a"]).alias("low"), at(F.col("_e")["b"]).alias("high"))


def allele_freq_compare(post: DataFrame) -> DataFrame:
    """P(f1 < f2) of each two populations at a locus; equal grid points count half."""
    a, b = (post.select(*LOCUS, F.col("pop").alias(f"pop{k}"), F.col("post").alias(f"_p{k}")) for k in (1, 2))
    rows = a.join(b, LOCUS).where("pop1 < pop2")
    start = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("p"))
    both = F.arrays_zip("_p1", "_p2")
    p = F.aggregate(both, start, lambda acc, x: F.struct((acc["c"] + x["_p1"]).alias("c"), (acc["p"] + x["_p2"] * (acc["c"] + x["_p1"] / 2)).alias("p")), lambda acc: acc["p"])
    return rows.select(*LOCUS, "pop1", "pop2", F.round(p, 6).alias("p_less"))


def inbreeding_surface(gl: DataFrame, grid=(0.0, 0.1, 0.2, 0.3, 0.5), iterations: int = 3) -> DataFrame:
    """Log likelihood of each inbreeding coefficient, with each locus's frequency fitted under it by a few EM steps."""
    rows = likelihoods(gl).groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("sample", "l0", "l1", "l2"))).alias("_s"))
    rows = rows.withColumn("f", F.explode(F.array(*map(F.lit, grid)))).withColumn("_p", F.lit(0.5))

    def weights(s, p):
        pq = p * (1 - p)
        return s["l0"] * ((1 - p) * (1 - p) + F.col("f") * pq), s["l1"] * 2 * pq * (1 - F.col("f")), s["l2"] * (p * p + F.col("f") * pq)

    def dose(s, p):
        w0, w1, w2 = weights(s, p)
        return (w1 + 2 * w2) / (w0 + w1 + w2)

    for _ in range(iterations):
        rows = rows.withColumn("_p", F.aggregate("_s", F.lit(0.0), lambda a, s: a + dose(s, F.col("_p"))) / (2 * F.size("_s")))
    ll = F.aggregate("_s", F.lit(0.0), lambda a, s: a + F.ln(sum(weights(s, F.col("_p")))))
    return rows.select("f", ll.alias("_ll")).groupBy("f").agg(F.round(F.sum("_ll"), 3).alias("ll"))


def _corr(x: str, y: str) -> Column:
    """Correlation of a group, null where either side has one value only."""
    spread = F.var_pop(x) * F.var_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / F.sqrt(spread))


def spearman(gl: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """Rank correlation, ties sharing their mean rank, of each locus's mean genotype with the samples' trait."""
    rows = likelihoods(gl).withColumn("_d", F.round(F.col("l1") + 2 * F.col("l2"), 6)).join(phenotypes, "sample")

    def ranked(c: str) -> Column:
        w = Window.partitionBy(*LOCUS)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*LOCUS, c)) - 1) / 2

    rows = rows.withColumns({"_x": ranked("_d"), "_y": ranked("trait")})
    return rows.groupBy(*LOCUS).agg(F.count("*").alias("n"), (F.round(_corr("_x", "_y"), 6) + 0.0).alias("rho")).where("n >= 3 AND rho IS NOT NULL")


def incomplete_beta(a: Column, b: Column, x: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta function by its continued fraction, on the side where that converges fast."""
    def fraction(a: Column, b: Column, x: Column) -> Column:
        tiny, one = F.lit(1e-300), F.lit(1.0)
        kept = lambda v: F.when(F.abs(v) < tiny, tiny).otherwise(v)
        start = F.struct(one.alias("c"), (1 / kept(1 - (a + b) * x / (a + 1))).alias("d"), (1 / kept(1 - (a + b) * x / (a + 1))).alias("h"))

        def step(at: Column, m: Column) -> Column:
            even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            c1, d1 = kept(1 + even / at["c"]), 1 / kept(1 + even * at["d"])
            c2, d2 = kept(1 + odd / c1), 1 / kept(1 + odd * d1)
            return F.struct(c2.alias("c"), d2.alias("d"), (at["h"] * d1 * c1 * d2 * c2).alias("h"))

        return F.aggregate(F.sequence(F.lit(1.0).cast("int"), F.lit(terms)), start, lambda at, m: step(at, m.cast("double")), lambda at: at["h"])

    front = F.exp(a * F.ln(x) + b * F.ln(1 - x) + _ln_gamma(a + b) - _ln_gamma(a) - _ln_gamma(b))
    inside = F.when(x < (a + 1) / (a + b + 2), front * fraction(a, b, x) / a).otherwise(1 - front * fraction(b, a, 1 - x) / b)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def _ln_gamma(z: Column) -> Column:
    """Stirling's series, moved up by ten so that it is exact to twelve places."""
    up = z + 10
    series = (up - 0.5) * F.ln(up) - up + 0.5 * float(np.log(2 * np.pi)) + 1 / (12 * up) - 1 / (360 * up**3) + 1 / (1260 * up**5) - 1 / (1680 * up**7)
    return series - F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda s, i: s + F.ln(z + i))


def spearman_pooled(gl: DataFrame, phenotypes: DataFrame, permutations: int = 0, threshold: float = 0.05) -> DataFrame:
    """Association of each locus with a trait by ranks within populations, pooled: n, n_pops, f, p, and p_permuted.

    Ranks of the mean genotype and of the trait are standardised in each population, by the variance over n - 1; ties share their
    mean rank. f compares the residual squares around no slope and around one slope for each population, with n_pops and
    n - n_pops degrees of freedom; p is its upper tail. Populations in which either side has one value only tell nothing and
    don't count. For loci with p below the threshold genotypes are permuted within populations, in an order drawn by hash
    from the locus, the sample and the permutation, so a run can be repeated; p_permuted is the share of permutations,
    the data themselves included, of an f as high. It is null for other loci.

    A rank is held as twice its distance from the mean rank, a whole number, so a population's sums are exact and no order of
    rows changes them; populations are added as decimals for the same reason.
    """
    rows = likelihoods(gl).withColumn("_d", F.round(F.col("l1") + 2 * F.col("l2"), 6)).join(phenotypes, "sample")
    own = [*LOCUS, "pop"]

    def ranked(c: str) -> Column:
        twice = 2 * F.rank().over(Window.partitionBy(*own).orderBy(c)) + F.count("*").over(Window.partitionBy(*own, c)) - F.count("*").over(Window.partitionBy(*own)) - 2
        return twice.cast("double")

    product = lambda x, y: F.sum(F.col(x) * F.col(y)).alias(x + y)
    rows = rows.select(*own, "sample", ranked("_d").alias("_x"), ranked("trait").alias("_y"))
    sums = product("_x", "_x"), product("_y", "_y"), product("_x", "_y")
    rows = rows.groupBy(*own).agg(F.count("*").alias("_n"), *sums, F.array_sort(F.collect_list(F.struct("sample", "_x", "_y"))).alias("_s"))  # a population's samples
    rows = rows.where("_n > 1 AND _x_x > 0 AND _y_y > 0")

    def pooled(rows: DataFrame, *keys: str) -> DataFrame:
        """f over populations from their sums of products and sizes _n."""
        explained = (F.col("_n") - 1) * (F.col("_x_y") / F.col("_x_x")) * (F.col("_x_y") / F.col("_y_y"))
        explained, n, pops = F.sum(explained.cast("decimal(38,18)")).cast("double"), F.sum("_n"), F.count("*")
        got = rows.groupBy(*keys).agg(n.alias("n"), pops.alias("n_pops"), explained.alias("_e"), (n - pops - explained).alias("_l"))
        got = got.where("n > n_pops")
        return got.withColumn("f", F.when(F.col("_l") > 1e-12, F.col("_e") / F.col("_l") * (F.col("n") - F.col("n_pops")) / F.col("n_pops")).otherwise(float("inf"))).drop("_e", "_l")

    out = pooled(rows, *LOCUS)
    d1, d2 = F.col("n_pops").cast("double"), (F.col("n") - F.col("n_pops")).cast("double")
    tail = incomplete_beta(d2 / 2, d1 / 2, F.when(F.col("f") < float("inf"), d2 / (d2 + d1 * F.col("f"))).otherwise(0.0))
    out = out.withColumn("p", tail)
    if not permutations:
        return out.withColumn("p_permuted", F.lit(None).cast("double"))
    low = rows.join(out.where(F.col("p") < threshold).select(*LOCUS, F.col("f").alias("_f")), LOCUS)
    low = low.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
    mixed = F.array_sort(F.transform("_s", lambda s: F.struct(F.xxhash64(*LOCUS, s["sample"], F.col("_k")).alias("u"), s["_x"].alias("x"))))
    low = low.withColumn("_m", mixed)
    low = low.withColumn("_x_y", F.aggregate(F.zip_with("_s", "_m", lambda s, m: s["_y"] * m["x"]), F.lit(0.0), lambda t, v: t + v))
    drawn = pooled(low, *LOCUS, "_k", "_f").groupBy(*LOCUS).agg(F.count_if(F.col("f") >= F.col("_f") - 1e-9).alias("_c"))
    return out.join(drawn, LOCUS, "left").withColumn("p_permuted", (F.col("_c") + 1) / (permutations + 1)).drop("_c")


def to_lfmm(gl: DataFrame, block: int) -> DataFrame:
    """A row for each sample and block of loci: its copies of the alternative allele in order. Blocks bound a row."""
    rows = gl.groupBy("sample", "chrom", F.floor(F.col("pos") / block).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "gt"))).alias("_l"))
    return rows.select("sample", "chrom", "block", F.array_join(F.transform("_l", lambda x: x["gt"].cast("string")), " ").alias("line"))


def to_sambada(gl: DataFrame) -> DataFrame:
    """Presence of each genotype by sample and locus."""
    return gl.select("sample", *LOCUS, *((F.col("gt") == k).cast("int").alias(f"has{k}") for k in range(3)))


def to_vcf(gl: DataFrame, samples: int, fields: tuple[str, ...] = ("GT", "DP", "PL"), info: tuple[str, ...] = ()) -> DataFrame:
    """Body lines of VCF text: the FORMAT fields asked for of each sample; a missing sample is ./. alone.

    gl has ref and alt, the letters of a locus, and ploidy if samples may be haploid, whose cells have one allele and the
    two likelihoods pl0 and pl2. info: DP (depth of all samples), NS (samples with data), AF (share of alternative alleles).
    """
    haploid = F.col("ploidy") == 1 if "ploidy" in gl.columns else F.lit(False)
    gt = F.when(haploid, F.col("gt").cast("string")).otherwise(F.element_at(F.array(F.lit("0/0"), F.lit("0/1"), F.lit("1/1")), F.least(F.lit(2), F.col("gt")).cast("int") + 1))
    pl = F.when(haploid, F.concat_ws(",", "pl0", "pl2")).otherwise(F.concat_ws(",", "pl0", "pl1", "pl2"))
    cell = F.concat_ws(":", *({"GT": gt, "DP": F.col("dp").cast("string"), "PL": pl}[f] for f in fields))
    copies = F.when(haploid, 1).otherwise(2)
    facts = {"DP": F.sum("dp").cast("string"), "NS": F.count("*").cast("string"), "AF": F.round(F.sum("gt") / F.sum(copies), 4).cast("string")}
    rows = gl.groupBy(*LOCUS).agg(F.min("ref").alias("_ref"), F.min("alt").alias("_alt"), F.map_from_entries(F.collect_list(F.struct("sample", cell.alias("v")))).alias("_m"), *(facts[k].alias(f"_{k}") for k in info))
    cells = [F.coalesce(F.element_at("_m", F.lit(s).cast("long")), F.lit("./.")) for s in range(samples)]
    said = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.col(f"_{k}")) for k in info)) if info else F.lit(".")
    fixed = [F.col("chrom").cast("string"), F.col("pos").cast("string"), F.lit("."), F.col("_ref"), F.col("_alt"), F.lit("."), F.lit("PASS"), said, F.lit(":".join(fields))]
    return rows.select(*LOCUS, F.concat_ws("\t", *fixed, *cells).alias("line"))


def read_counts(cells: DataFrame, pops: list[int]) -> DataFrame:
    """minor/total cells of a wide table as rows of numbers; a total of 0 is missing."""
    rows = cells.select(*LOCUS, F.inline(F.array(*(F.struct(F.lit(p).alias("pop"), F.col(f"pop{p}").alias("_c")) for p in pops))))
    part = lambda k: F.element_at(F.split("_c", "/"), k).cast("long")
    return rows.select(*LOCUS, "pop", part(1).alias("n_minor"), part(2).alias("n_total")).where("n_total > 0")


def inbreeding_estimate(surface: DataFrame) -> DataFrame:
    """The likeliest coefficient of a surface, the least of several, and twice its log likelihood above that of none."""
    best = F.max_by("f", F.struct("ll", -F.col("f")))
    none = F.max(F.when(F.col("f") == 0, F.col("ll")))
    return surface.agg(best.alias("f"), F.round(F.max("ll"), 3).alias("ll"), F.round(2 * (F.max("ll") - none), 3).alias("ratio"))
