"""Estimates that refine themselves: credible intervals on a second grid, frequencies of an allele pair until they stand
still, and the inbreeding coefficient by narrowing brackets.

What belongs to one locus is worked out in its row, by folds over its samples; what belongs to all loci is one aggregate a round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators.loci import PAIRS
from helixmill.operators.population import LOCUS, likelihoods
from helixmill.sources.files import stored

SITE = ["chrom", "site"]
EDGE = 1e-16  #: the least frequency that has a density, and the distance of the greatest from one


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys over as many tasks as a shuffle has, for folds that cost time and not bytes: no rule by size may merge them.

    A grouping by the same keys that follows needs no other exchange.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def credible_intervals(gl: DataFrame, alpha: float = 0.7, beta: float = 0.7, interval: float = 0.9, coarse: int = 101, fine: int = 1001, below: float = 14.0) -> DataFrame:
    """Likeliest allele frequency of each locus and population, and the credible interval grown from it.

    The log posterior under Hardy-Weinberg proportions and a beta prior is taken on a coarse grid over [0, 1]. Points less than
    ``below`` under its greatest value, and one more on both sides, are the range of the fine grid, whose highest point is
    map. From there the interval grows by one step at a time, on the side where the density is higher (left if equal), until
    it holds its share of the mass; the last step is cut where the share is met. If gl has ploidy, a sample of ploidy 1
    has the likelihoods of its two alleles in pl0 and pl2. Densities are rounded to nine places before they are compared.
    """
    haploid = F.col("ploidy") == 1 if "ploidy" in gl.columns else F.lit(False)
    rows = dealt(likelihoods(gl), *LOCUS, "pop").groupBy(*LOCUS, "pop").agg(F.array_sort(F.collect_list(F.struct("sample", "l0", "l1", "l2", haploid.alias("one")))).alias("_s"))

    def log_density(f: Column) -> Column:
        q = 1 - f
        of = lambda s: F.when(s["one"], s["l0"] * q + s["l2"] * f).otherwise(s["l0"] * q * q + s["l1"] * 2 * f * q + s["l2"] * f * f)
        return F.round(F.aggregate("_s", (alpha - 1) * F.ln(f) + (beta - 1) * F.ln(q), lambda t, s: t + F.ln(of(s))), 9)

    clamp = lambda f: F.least(F.greatest(f, F.lit(EDGE)), F.lit(1 - EDGE))
    first = F.array(*(F.lit(min(max(i / (coarse - 1), EDGE), 1 - EDGE)) for i in range(coarse)))

    def spread(d: Column) -> Column:
        """Ends of the fine grid, from densities on the coarse one."""
        top = F.array_max(d)
        near = F.filter(F.transform(d, lambda x, i: F.when(x >= top - below, i)), lambda i: i.isNotNull())
        lo, hi = F.greatest(F.array_min(near) - 1, F.lit(0)), F.least(F.array_max(near) + 1, F.lit(coarse - 1))
        return F.struct((lo / (coarse - 1)).alias("lo"), (hi / (coarse - 1)).alias("hi"))

    def grown(d: Column, lo: Column, step: Column) -> Column:
        """(map, low, high) of relative densities d at lo + i * step."""
        place = lambda i: lo + i * step
        whole = F.aggregate(d, F.lit(0.0), lambda t, x: t + x) - (F.get(d, F.lit(0)) + F.get(d, F.lit(fine - 1))) / 2
        best = (F.array_position(d, F.array_max(d)) - 1).cast("int")

        def walk(at: Column) -> Column:
            top, need = at["best"], at["need"]
            state = F.struct(top.alias("l"), top.alias("r"), F.lit(0.0).alias("c"), place(top).alias("low"), place(top).alias("high"), F.lit(False).alias("done"))

            def add(s: Column, _: Column) -> Column:
                left = F.when(s["l"] > 0, F.get(d, s["l"] - 1)).otherwise(-1.0)
                right = F.when(s["r"] < fine - 1, F.get(d, s["r"] + 1)).otherwise(-1.0)

                def move(h: Column) -> Column:
                    to_right = h["right"] > h["left"]
                    mass = F.when(to_right, h["right"] + F.get(d, s["r"])).otherwise(h["left"] + F.get(d, s["l"])) / 2
                    return bound(F.struct(to_right.alias("to_right"), mass.alias("mass"), F.least(F.lit(1.0), (need - s["c"]) / mass).alias("share")), lambda m: moved(s, m))

                return F.when(s["done"] | ((s["l"] == 0) & (s["r"] == fine - 1)), s).otherwise(bound(F.struct(left.alias("left"), right.alias("right")), move))

            def moved(s: Column, m: Column) -> Column:
                right = m["to_right"]
                return F.struct(
                    F.when(right, s["l"]).otherwise(s["l"] - 1).alias("l"), F.when(right, s["r"] + 1).otherwise(s["r"]).alias("r"), (s["c"] + m["mass"]).alias("c"),
                    F.when(right, s["low"]).otherwise(place(s["l"] - m["share"])).alias("low"), F.when(right, place(s["r"] + m["share"])).otherwise(s["high"]).alias("high"),
                    (s["c"] + m["mass"] >= need).alias("done"),
                )

            return F.aggregate(F.sequence(F.lit(1), F.lit(fine - 1)), state, add, lambda s: F.struct(place(top).alias("map"), s["low"].alias("low"), s["high"].alias("high")))

        return bound(F.struct(best.alias("best"), (whole * interval).alias("need")), walk)

    def refined(ends: Column) -> Column:
        step = (ends["hi"] - ends["lo"]) / (fine - 1)
        logs = F.transform(F.sequence(F.lit(0), F.lit(fine - 1)), lambda i: log_density(clamp(ends["lo"] + i * step)))
        relative = bound(logs, lambda v: bound(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top))))
        return bound(relative, lambda d: grown(d, ends["lo"], step))

    got = bound(F.transform(first, log_density), lambda d: bound(spread(d), refined))
    return rows.select(*LOCUS, "pop", got.alias("_g")).select(*LOCUS, "pop", *(F.round(F.col("_g")[c], 6).alias(c) for c in ("map", "low", "high")))


def pair_frequencies(sites: DataFrame, sample: str, min_maf: float = 0.0, least_change: float = 1e-7, iterations: int = 1000) -> DataFrame:
    """The likeliest allele pair of each site at frequency one half, then an EM for its genotype and allele frequencies.

    sites has a row for each sample with its ten likelihoods; if it has ploidy, those of ploidy 1 use the four homozygous
    ones. Haploid samples have an allele frequency and diploid ones three genotype frequencies, which start at the shares of
    likeliest genotypes (1e-6 at least). Returned per site: allele_pair, major and minor allele (the second of the pair is major
    from one half on), maf over all copies, log10 likelihood ll, steps, and state: ``still`` if no frequency moved by
    least_change, ``rare`` if it stopped as another move as great could not lift maf to min_maf (before the first step, if maf is
    below half of it), else ``moving``. That rule saves steps and is no proof: many small moves might have lifted it. Likelihoods are rounded to nine places before they are compared.
    """
    at = {g: i + 1 for i, g in enumerate(GENOTYPES)}
    haploid = F.col("ploidy") == 1 if "ploidy" in sites.columns else F.lit(False)
    g = {p: F.element_at("gl", i) for p, i in at.items()}
    half = [F.sum(F.ln(F.when(haploid, (g[a, a] + g[b, b]) / 2).otherwise(g[a, a] / 4 + g[a, b] / 2 + g[b, b] / 4))).alias(f"_p{k}") for k, (a, b) in enumerate(PAIRS)]
    rows = sites.groupBy(*SITE).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("sample"), haploid.alias("one"), "gl"))).alias("_s"), *half)  # as many as there are samples
    rows = rows.withColumn("_l", F.array(*(F.round(f"_p{k}", 9) for k in range(6))))
    rows = rows.withColumn("allele_pair", (F.array_position("_l", F.array_max("_l")) - 1).cast("int"))
    number = lambda pick: F.element_at(F.array(*(F.lit(pick(a, b)) for a, b in PAIRS)), F.col("allele_pair") + 1)
    rows = rows.withColumns({"_0": number(lambda a, b: at[a, a]), "_1": number(lambda a, b: at[a, b]), "_2": number(lambda a, b: at[b, b])})
    three = lambda s: F.struct(s["one"].alias("one"), *(F.element_at(s["gl"], F.col(f"_{k}")).alias(f"l{k}") for k in range(3)))
    rows = rows.withColumn("_s", F.transform("_s", three))

    def total(term: Callable[[Column], Column]) -> Column:
        return F.aggregate("_s", F.lit(0.0), lambda t, s: t + term(s))

    near = lambda c: F.round(c, 9)
    best = lambda s, k: F.when(near(s["l0"]) >= F.greatest(near(s["l1"]), near(s["l2"])), k == 0).when(near(s["l1"]) >= near(s["l2"]), k == 1).otherwise(k == 2)
    share = lambda yes: F.when(yes, 1.0).otherwise(0.0)
    starts = {"nh": total(lambda s: share(s["one"])), "nd": total(lambda s: share(~s["one"])), "c1": total(lambda s: share(s["one"] & (near(s["l2"]) > near(s["l0"]))))}
    starts |= {f"d{k}": total(lambda s, k=k: share(~s["one"] & best(s, F.lit(k)))) for k in range(3)}
    rows = rows.withColumn("_c", F.struct(*(v.alias(c) for c, v in starts.items())))
    c = F.col("_c")
    nh, nd = F.col("_c")["nh"], F.col("_c")["nd"]
    floor = lambda n, of: F.greatest(F.when(of > 0, n / of).otherwise(0.0), F.lit(1e-6))
    h = [floor(nh - c["c1"], nh), floor(c["c1"], nh)]
    d = [floor(c[f"d{k}"], nd) for k in range(3)]
    names = ("h1", "d0", "d1", "d2")
    first = [h[1] / (h[0] + h[1]), *(x / (d[0] + d[1] + d[2]) for x in d)]
    alt = lambda p: (nd * (p["d1"] + 2 * p["d2"]) + nh * p["h1"]) / (nh + 2 * nd)
    minor = lambda x: F.least(x, 1 - x)
    rows = rows.withColumn("_p", F.struct(*(x.alias(k) for k, x in zip(names, first, strict=True))))

    def posterior(s: Column, p: Column) -> list[Column]:
        two = [s["l0"] * p["d0"], s["l1"] * p["d1"], s["l2"] * p["d2"]]
        return [s["l2"] * p["h1"] / (s["l0"] * (1 - p["h1"]) + s["l2"] * p["h1"]), *(x / (two[0] + two[1] + two[2]) for x in two)]

    def step(p: Column, _: Column) -> Column:
        zero = F.struct(*(F.lit(0.0).alias(k) for k in names))
        add = lambda t, s: F.struct(*((t[k] + F.when(s["one"] if k == "h1" else ~s["one"], x).otherwise(0.0)).alias(k) for k, x in zip(names, posterior(s, p), strict=True)))
        shares = F.aggregate("_s", zero, add, lambda t: F.struct(*(F.when((nh if k == "h1" else nd) > 0, t[k] / (nh if k == "h1" else nd)).otherwise(p[k]).alias(k) for k in names)))

        def after(q: Column) -> Column:
            change = F.greatest(*(F.abs(q[k] - p[k]) for k in names))
            state = F.when(minor(alt(q)) < min_maf - change, "rare").when(change < least_change, "still").otherwise("moving")
            return F.struct(*(q[k].alias(k) for k in names), (p["steps"] + 1).alias("steps"), state.alias("state"))

        return F.when(p["state"] != "moving", p).otherwise(bound(shares, after))

    state = F.when(minor(alt(F.col("_p"))) < min_maf / 2, "rare").otherwise("moving")
    begin = F.struct(*(F.col("_p")[k].alias(k) for k in names), F.lit(0).alias("steps"), state.alias("state"))
    rows = rows.withColumn("_e", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), begin, step))
    e = F.col("_e")
    ll = total(lambda s: F.log10(F.when(s["one"], s["l0"] * (1 - e["h1"]) + s["l2"] * e["h1"]).otherwise(s["l0"] * e["d0"] + s["l1"] * e["d1"] + s["l2"] * e["d2"])))
    a, b = number(lambda a, b: a), number(lambda a, b: b)
    swap = near(alt(e)) >= 0.5
    out = {"allele_pair": F.col("allele_pair"), "major": F.when(swap, b).otherwise(a), "minor": F.when(swap, a).otherwise(b), "maf": F.round(minor(alt(e)), 6), "ll": F.round(ll, 6) + 0.0}
    return rows.select(*SITE, (nh + nd).cast("long").alias("n_samples"), *(v.alias(k) for k, v in out.items()), e["steps"].alias("steps"), e["state"].alias("state"))


def _inbred(s: Column, p: Column, f: Column) -> list[Column]:
    """Weights of a sample's genotypes: two alleles drawn apart (three weights), or one drawn and copied (two)."""
    q, apart = 1 - p, 1 - f
    return [s["l0"] * apart * q * q, s["l1"] * apart * 2 * p * q, s["l2"] * apart * p * p, s["l0"] * f * q, s["l2"] * f * p]


def _fitted(rows: DataFrame, steps: int) -> DataFrame:
    """Adds p, each locus's allele frequency under the coefficient f of its row, and the log likelihoods there and without minor alleles.

    A likelihood below the least double is 0, its logarithm in g0 or g2 is not. With f = 1 heterozygotes don't count, and
    the greater of the two others is the scale.
    """
    whole, top = F.col("f") == 1, lambda s: F.greatest(s["g0"], s["g2"])
    scaled = lambda s, k: F.when(whole, F.exp(s[f"g{k}"] - top(s)) if k != 1 else F.lit(0.0)).otherwise(s[f"l{k}"]).alias(f"l{k}")
    rows = rows.withColumn("_s", F.transform("_s", lambda s: F.struct(s["sample"].alias("sample"), *(scaled(s, k) for k in range(3)), s["g0"].alias("g0"), s["g2"].alias("g2"), F.when(whole, top(s)).otherwise(0.0).alias("scale"))))

    def step(p: Column, _: Column) -> Column:
        def add(t: Column, s: Column) -> Column:
            w = _inbred(s, p, F.col("f"))
            return F.struct((t["x"] + (w[1] + 2 * w[2] + w[4]) / sum(w[1:], w[0])).alias("x"), (t["n"] + (2 * (w[0] + w[1] + w[2]) + w[3] + w[4]) / sum(w[1:], w[0])).alias("n"))

        return F.aggregate("_s", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("n")), add, lambda t: t["x"] / t["n"])

    ll = lambda p: F.aggregate("_s", F.lit(0.0), lambda t, s: t + s["scale"] + F.ln(sum(_inbred(s, p, F.col("f"))[1:], _inbred(s, p, F.col("f"))[0])))
    rows = rows.withColumn("p", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.5), step))
    one = F.greatest(*(F.aggregate("_s", F.lit(0.0), lambda t, s: t + s[k]) for k in ("g0", "g2")))
    return rows.withColumns({"ll": ll(F.col("p")), "ll_one": one})


def _by_locus(gl: DataFrame) -> DataFrame:
    rows, total = likelihoods(gl), F.ln(sum(F.pow(F.lit(10.0), -F.col(f"pl{k}") / 10) for k in range(3)))
    rows = rows.withColumns({f"g{k}": -F.col(f"pl{k}") / 10 * F.ln(F.lit(10.0)) - total for k in (0, 2)})
    return dealt(rows, *LOCUS).groupBy(*LOCUS).agg(F.array_sort(F.collect_list(F.struct("sample", "l0", "l1", "l2", "g0", "g2"))).alias("_s"))


def inbreeding_loci(gl: DataFrame, f: float, steps: int = 50) -> DataFrame:
    """Allele frequency p of each locus under an inbreeding coefficient, by EM over drawn and copied alleles, and its ll.

    monomorphic: one allele alone explains the locus as well, up to a thousandth in ll.
    """
    rows = _fitted(_by_locus(gl).withColumn("f", F.lit(float(f))), steps)
    return rows.select(*LOCUS, F.size("_s").cast("long").alias("n"), F.round("p", 6).alias("p"), F.round("ll", 6).alias("ll"), (F.round("ll_one", 6) >= F.round(F.col("ll") - 0.001, 6)).alias("monomorphic"))


def inbreeding_fit(gl: DataFrame, tolerance: float = 1e-4, points: int = 9, steps: int = 50) -> DataFrame:
    """The likeliest inbreeding coefficient, by rounds that narrow its bracket to the neighbours of the best of some points.

    Each round is one aggregate over the stored loci, of as many numbers as there are points. Returned: f, ll, ratio (twice
    the log likelihood above that without inbreeding), rounds, and monomorphic, the share of loci that one allele explains.
    """
    rows, lo, hi, rounds, none = stored(_by_locus(gl)), 0.0, 1.0, 0, None
    while True:
        grid = [float(x) for x in np.linspace(lo, hi, points)]
        each = _fitted(rows.withColumn("f", F.explode(F.array(*map(F.lit, grid)))), steps)
        alone = (F.col("ll_one") >= F.col("ll") - 0.001).cast("double")
        got = {r["f"]: r for r in each.groupBy("f").agg(F.sum("ll").alias("ll"), F.avg(alone).alias("alone")).collect()}  # a row for each point
        schema = "f double, ll double, ratio double, rounds int, monomorphic double"
        if not got:
            return gl.sparkSession.createDataFrame([], schema)
        none = got[0.0]["ll"] if none is None else none
        k = max(range(points), key=lambda i: (got[grid[i]]["ll"], -i))
        rounds += 1
        lo, hi = grid[max(0, k - 1)], grid[min(points - 1, k + 1)]
        if hi - lo <= tolerance:
            best = got[grid[k]]
            return gl.sparkSession.createDataFrame([(grid[k], best["ll"], 2 * (best["ll"] - none), rounds, best["alone"])], schema)
