"""Theta and base frequencies together, of all windows of a genome at once or of the genome as a whole.

Two alleles are one draw of a base with probability e = exp(-theta), else two. A step of the EM is one aggregate keyed by
window: ten sums of genotype posteriors, from which the new e and frequencies follow in the window's row. So no window is
anybody's group, however long it is, and parameters are a table of a row for each window, stored after each step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators.reads import hashed_share
from helixmill.operators.sized import few
from helixmill.sources.files import stored

STARTS = tuple(10 ** (-5 + 0.5 * i) for i in range(11))  #: a multiplicative search
PI = tuple(f"pi{b}" for b in range(4))


def _prior(e: Column) -> list[Column]:
    """P(genotype) from e and the columns pi0 to pi3."""
    pi = [F.col(c) for c in PI]
    return [pi[a] * (e + pi[a] * (1 - e)) if a == b else 2 * pi[a] * pi[b] * (1 - e) for a, b in GENOTYPES]


def _gl(i: int) -> Column:
    return F.element_at("gl", i + 1)


def _joined(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(few(table), keys)


def _maximised(inner: int) -> Column:
    """e and frequencies that the ten sums s0 to s9 make most likely, from those before: draws are counted ``inner`` times."""
    s, hom = [F.col(f"s{i}") for i in range(10)], [GENOTYPES.index((b, b)) for b in range(4)]
    whole = sum(s)
    start = F.struct(F.col("e").alias("e"), *(F.col(c).alias(c) for c in PI))

    def step(at: Column, _: Column) -> Column:
        one = [s[hom[b]] * at["e"] / (at["e"] + at[PI[b]] * (1 - at["e"])) for b in range(4)]  # a single draw
        draws = [2 * s[hom[b]] - one[b] + sum(s[i] for i, g in enumerate(GENOTYPES) if b in g and g[0] != g[1]) for b in range(4)]
        e = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), sum(one) / whole))
        return F.struct(e.alias("e"), *(F.greatest(F.lit(1e-9), draws[b] / sum(draws)).alias(PI[b]) for b in range(4)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(inner)), start, step)


def begun(rows: DataFrame, keys: list[str], start: float | None = None) -> DataFrame:
    """n_sites, e and frequencies to begin with: the mean posterior frequencies, and ``start`` or the best of STARTS for theta."""
    total = sum(_gl(i) for i in range(10))
    freqs = [F.sum(F.col("weight") * sum(_gl(i) * g.count(b) for i, g in enumerate(GENOTYPES) if b in g) / (2 * total)).alias(f"_{b}") for b in range(4)]
    table = rows.groupBy(*keys).agg(F.sum("weight").alias("n_sites"), *freqs)
    share = lambda b: F.greatest(F.lit(1e-6), F.col(f"_{b}") / F.col("n_sites"))
    table = table.select(*keys, "n_sites", *((share(b) / sum(share(k) for k in range(4))).alias(PI[b]) for b in range(4)))
    if start is not None:
        return stored(table.withColumn("e", F.exp(F.lit(-start))))
    table = stored(table)
    lls = [F.sum(F.col("weight") * F.ln(sum(_gl(i) * p for i, p in enumerate(_prior(F.exp(F.lit(-t))))))).alias(f"_{k}") for k, t in enumerate(STARTS)]
    found = _joined(rows, table, keys).groupBy(*keys).agg(*lls)
    best = F.array_max(F.array(*(F.struct(F.col(f"_{k}").alias("ll"), F.exp(F.lit(-t)).alias("e")) for k, t in enumerate(STARTS))))
    return stored(table.join(found.select(*keys, best["e"].alias("e")), keys))


def stepped(rows: DataFrame, table: DataFrame, keys: list[str], inner: int) -> DataFrame:
    """The table after a step; ll is the log likelihood of the parameters that the step began with."""
    held = _joined(rows, table, keys).withColumns({f"_w{i}": _gl(i) * p for i, p in enumerate(_prior(F.col("e")))})
    held = held.withColumn("_t", sum(F.col(f"_w{i}") for i in range(10)))
    sums = held.groupBy(*keys).agg(F.sum(F.col("weight") * F.ln("_t")).alias("ll"), *(F.sum(F.col("weight") * F.col(f"_w{i}") / F.col("_t")).alias(f"s{i}") for i in range(10)))
    new = table.drop("ll").join(sums, keys).withColumn("_m", _maximised(inner))
    return new.select(*keys, "n_sites", "ll", F.col("_m.e").alias("e"), *(F.col(f"_m.{c}").alias(c) for c in PI))


def theta(sites: DataFrame, keys: list[str], max_steps: int = 50, min_gain: float = 1e-4, inner: int = 20, min_sites: int = 1000, start: float | None = None) -> DataFrame:
    """keys, n_sites, theta, half_width, het, pi0 to pi3 and ll: a row for each value of keys; without keys, of all sites as one.

    sites have gl, and weight if they don't count once each. Steps go on until no window's log likelihood rises by
    min_gain. half_width is half the 95 % interval from the observed information, het the expected heterozygosity.
    Windows of fewer than min_sites sites have a row without estimates; a site without any likelihood isn't one.
    """
    held = sites.where(F.exists("gl", lambda x: x > 0))
    weight = F.col("weight").cast("double") if "weight" in sites.columns else F.lit(1.0)
    own = keys or ["_all"]
    rows = stored(held.select(*([F.col(k) for k in keys] or [F.lit(0).alias("_all")]), "gl", weight.alias("weight")).where("weight > 0"))
    every = begun(rows, own, start)
    table, last = every.where(F.col("n_sites") >= min_sites), None
    for _ in range(max_steps):
        new = stored(stepped(rows, table, own, inner))
        if last is not None:
            gain = new.join(last, own).agg(F.max(F.col("ll") - F.col("_last"))).first()[0]
            if gain is None or gain < min_gain:
                table = new
                break
        table, last = new, new.select(*own, F.col("ll").alias("_last"))
    e = F.col("e")
    slope = [-e * F.col(PI[a]) * (1 - F.col(PI[a])) if a == b else 2 * e * F.col(PI[a]) * F.col(PI[b]) for a, b in GENOTYPES]
    r = sum(_gl(i) * x for i, x in enumerate(slope)) / sum(_gl(i) * p for i, p in enumerate(_prior(e)))
    info = _joined(rows, table, own).groupBy(*own).agg(F.sum(F.col("weight") * r * (r + 1)).alias("_info"))
    got = table.join(info, own).withColumns({"theta": -F.ln(e), "half_width": F.when(F.col("_info") > 0, 1.96 / F.sqrt("_info")), "het": (1 - e) * (1 - sum(F.col(c) * F.col(c) for c in PI))})
    out = every.select(*own, "n_sites").join(got.select(*own, "theta", "half_width", "het", *PI, "ll"), own, "left")
    return out.select(*keys, F.col("n_sites").cast("long").alias("n_sites"), "theta", "half_width", "het", *PI, "ll")


def replicates(sites: DataFrame, n: int, *key: str) -> DataFrame:
    """Sites once for each of n replicates and once as they are (replicate 0), with Poisson(1) weights drawn from key and replicate."""
    rows = sites.withColumn("replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long"))))
    u, weight, below, mass = hashed_share(*key, "replicate", seed=7), F.lit(0), 0.0, None
    for k in range(12):
        mass = 1 / 2.718281828459045 if k == 0 else mass / k
        below += mass
        weight = F.when(u >= below, k + 1).otherwise(weight)
    return rows.withColumn("weight", F.when(F.col("replicate") == 0, 1).otherwise(weight).cast("double")).where("weight > 0")
