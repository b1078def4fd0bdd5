"""Error rates by covariates, what a misread base is read as, genotype likelihoods with both, and their estimation.

The error rate of a base is logistic in a sum of functions of its covariates, which are small integers: so each function,
and its derivatives by its parameters, is a table by value, made on the driver and looked up by expressions. Fitting works
on distinct covariate tuples with their number of bases and of expected misreads; a Newton step is one aggregate of
k + k (k + 1) / 2 sums for k parameters, whatever the number of bases, and a damped one tries again with one sum.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from math import erf, exp, pi, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES, scaled_ten
from helixmill.operators import inference
from helixmill.operators.models import prior_mstep, substitution_table
from helixmill.sources.files import stored

SITE = ["chrom", "site"]
#: Columns of bases and their greatest values: the base sequenced before (4: none), whole log2 of the fragment's length, mapping quality, distance from the five-prime end, quality.
COVARIATES = {"context": 4, "fragment": 31, "mapping": 255, "position": 255, "quality": 93}
LEAST = 1e-10


@dataclass(frozen=True)
class Term:
    """A function of one covariate.

    polynomial: betas of x, x^2, ..., where x is the value, of a quality the logit of its error rate. probit: b0 Phi(b1 + b2 v).
    empiric: a beta for each of ``upto``, greatest values that it stands for; values beyond the last have the last one.
    """

    covariate: str
    kind: str
    betas: tuple[float, ...]
    upto: tuple[int, ...] = ()

    def tables(self) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """By value: the function, its derivatives by each beta, and the second ones that aren't zero."""
        v, b = np.arange(COVARIATES[self.covariate] + 1, dtype=float), np.array(self.betas)
        if self.kind == "polynomial":
            if self.covariate == "quality":
                e = np.clip(10 ** (-v / 10), LEAST, 1 - LEAST)
                v = np.log(e / (1 - e))
            d = np.stack([v ** (i + 1) for i in range(len(b))])
            return b @ d, d, {}
        if self.kind == "empiric":
            d = (np.minimum(np.searchsorted(self.upto, v), len(b) - 1)[None] == np.arange(len(b))[:, None]).astype(float)
            return b @ d, d, {}
        if self.kind != "probit":
            raise ValueError(f"no such function: {self.kind}")
        z = b[1] + b[2] * v
        phi, whole = np.array([exp(-x * x / 2) / sqrt(2 * pi) for x in z]), np.array([(1 + erf(x / sqrt(2))) / 2 for x in z])
        second = {(0, 1): phi, (0, 2): phi * v, (1, 1): -b[0] * phi * z, (1, 2): -b[0] * phi * z * v, (2, 2): -b[0] * phi * z * v * v}
        return b[0] * whole, np.stack([whole, b[0] * phi, b[0] * phi * v]), second


@dataclass(frozen=True)
class Model:
    intercept: float
    terms: tuple[Term, ...] = ()

    def parameters(self) -> np.ndarray:
        return np.array([self.intercept, *(b for t in self.terms for b in t.betas)])

    def moved(self, to: np.ndarray) -> Model:
        out, at = [], 1
        for t in self.terms:
            out.append(replace(t, betas=tuple(map(float, to[at : at + len(t.betas)]))))
            at += len(t.betas)
        return Model(float(to[0]), tuple(out))


def _looked_up(covariate: str, table: np.ndarray) -> Column:
    if not table.any():
        return F.lit(0.0)
    if (table == table[0]).all():
        return F.lit(float(table[0]))
    at = F.least(F.greatest(F.col(covariate), F.lit(0)), F.lit(len(table) - 1)).cast("int")
    return F.element_at(F.expr(f"array({', '.join(f'{float(x)!r}D' for x in table)})"), at + 1)  # one text: a call for each number takes longer than the job


def eta(model: Model) -> Column:
    return F.lit(model.intercept) + sum((_looked_up(t.covariate, t.tables()[0]) for t in model.terms), F.lit(0.0))


def rate(model: Model) -> Column:
    return F.least(F.lit(1 - LEAST), F.greatest(F.lit(LEAST), 1 / (1 + F.exp(-eta(model)))))


def with_rates(bases: DataFrame, models: dict[tuple[str, int], Model]) -> DataFrame:
    """Adds eps: by the model of a base's group and mate (rg, is_second), or the quality's own rate where there is none. Pools are few."""
    eps = F.pow(F.lit(10.0), -F.col("quality") / 10)
    for (rg, second), model in models.items():
        eps = F.when((F.col("rg") == rg) & (F.col("is_second") == second), rate(model)).otherwise(eps)
    return bases.withColumn("eps", eps)


def read_as(spot: str, k: int, rhos: list[list[list[float]]]) -> Column:
    """P(what the base is read as | it is a misread k), from rho[k][read] in the read's own direction, looked up at a spot: (rho's number * 2 + strand) * 4 + base."""
    turned = lambda c, rev: 3 - c if rev else c
    return F.get(F.array(*(F.lit(float(rho[turned(k, rev)][turned(b, rev)])) for rho in rhos for rev in (0, 1) for b in range(4))), F.col(spot))


def likelihoods(bases: DataFrame, rho: dict[str, list[list[float]]] | None = None) -> DataFrame:
    """Ten genotype likelihoods a site (greatest 1) from bases with eps: 1 - eps of the base itself, eps times rho of others.

    rho is by group; groups without one have thirds. Bases of N are left out.
    """
    number, rhos = F.lit(0), [[[1 / 3] * 4] * 4, *(rho or {}).values()]
    for i, rg in enumerate(rho or {}):
        number = F.when(F.col("rg") == rg, F.lit(i + 1)).otherwise(number)
    strand = F.when(F.col("is_rev") == 1, F.lit(1)).otherwise(F.lit(0)) if rho else F.lit(0)
    # one look-up for each base keeps the generated code of a row below the 8000 bytes that are compiled
    rows = bases.where("base < 4").withColumn("_spot", ((number * 2 + strand) * 4 + F.col("base")).cast("int"))
    for k in range(4):
        rows = rows.withColumn(f"_e{k}", F.when(F.col("base") == k, 1 - F.col("eps")).otherwise(F.col("eps") * read_as("_spot", k, rhos)))
    sums = [F.sum(F.ln((F.col(f"_e{a}") + F.col(f"_e{b}")) / 2) if a != b else F.ln(f"_e{a}")).alias(f"_g{i}") for i, (a, b) in enumerate(GENOTYPES)]
    rows = rows.groupBy(*SITE).agg(F.count("*").alias("depth"), *sums)
    return rows.select(*SITE, "depth", F.array(*(f"_g{i}" for i in range(10))).alias("logs")).withColumn("gl", scaled_ten("logs"))


def tuples(bases: DataFrame, wrong: Column, n: Column | None = None, names: tuple[str, ...] = tuple(COVARIATES)) -> DataFrame:
    """Distinct tuples of covariates (those that a model has are enough) with n, the bases that have them, and wrong, how many of these are (expected to be) misread."""
    n = F.lit(1) if n is None else n
    return bases.groupBy(*names).agg(F.sum(n).cast("double").alias("n"), F.sum(wrong * n).cast("double").alias("wrong"))


def used(model: Model) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t.covariate for t in model.terms))


def _gain() -> Column:
    return F.sum(F.col("wrong") * F.ln("_eps") + (F.col("n") - F.col("wrong")) * F.ln(1 - F.col("_eps")))


def newton_sums(rows: DataFrame, model: Model) -> DataFrame:
    """One row: q, the expected log likelihood; f0, f1, ...: its gradient; j0_0, j0_1, ...: the upper half of its Jacobian."""
    first, second = [F.lit(1.0)], {}
    for t in model.terms:
        at, (_, d, dd) = len(first), t.tables()
        first += [_looked_up(t.covariate, x) for x in d]
        second.update({(at + i, at + j): _looked_up(t.covariate, x) for (i, j), x in dd.items()})
    held = rows.withColumn("_eps", rate(model)).withColumns({f"_d{i}": x for i, x in enumerate(first)} | {f"_s{i}_{j}": x for (i, j), x in second.items()})
    held = held.withColumns({"_w": F.col("wrong") - F.col("n") * F.col("_eps"), "_v": F.col("n") * F.col("_eps") * (1 - F.col("_eps"))})
    k = range(len(first))
    curved = lambda i, j: F.col("_w") * F.col(f"_s{i}_{j}") if (i, j) in second else F.lit(0.0)
    jacobian = [F.sum(curved(i, j) - F.col("_v") * F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"j{i}_{j}") for i in k for j in k if i <= j]
    return held.agg(_gain().alias("q"), *(F.sum(F.col("_w") * F.col(f"_d{i}")).alias(f"f{i}") for i in k), *jacobian)


def fitted(rows: DataFrame, model: Model, steps: int = 20, halvings: int = 16, least: float = 1e-6) -> tuple[Model, float]:
    """Newton steps, each halved until the expected log likelihood rises, until none does or it rises by less than ``least``.

    rows as from ``tuples``, better stored or cached. A direction that the data say nothing about isn't moved in.
    """
    q = None
    for _ in range(steps):
        got = newton_sums(rows, model).first()
        if got["q"] is None:
            return model, 0.0
        p = model.parameters()
        f = np.array([got[f"f{i}"] for i in range(len(p))])
        j = np.array([[got[f"j{min(a, b)}_{max(a, b)}"] for b in range(len(p))] for a in range(len(p))])
        if np.linalg.eigvalsh(j).max() > 0:  # not at a maximum's side: without the curvature's part the step climbs
            j = j - np.eye(len(p)) * np.linalg.eigvalsh(j).max() * 1.01
        step, q, risen = np.linalg.lstsq(j, f, rcond=1e-12)[0], got["q"], False
        for _ in range(halvings):
            new = model.moved(p - step)
            after = rows.withColumn("_eps", rate(new)).agg(_gain().alias("q")).first()["q"]
            if after is not None and after > q:
                risen = True
                break
            step = step / 2
        if not risen:
            return model, q
        model, gain, q = new, after - q, after
        if gain < least:
            break
    return model, q


def estimate(bases: DataFrame, model: Model, prior: tuple[float, float, float] = (0.5, 0.001, 0.01), fit_prior: bool = True, max_iterations: int = 20, min_delta_ll: float = 1e-3, dists: int = 20) -> tuple[Model, list[list[float]], DataFrame]:
    """EM for the error rates, what misread bases are read as, the damage by distance, and the prior of genotypes given the
    reference (mu, theta_r, theta_g of the substitution model), until the likelihood rises by less than min_delta_ll.

    bases: chrom, site, ref, base, is_rev and the covariates. Returns the model, rho, and a row for each step: step, ll (of
    the parameters that it began with), psi_ct, psi_ga and the prior at the end. Each step is the E-step over all bases, and
    one aggregate by strand, base, distance and the model's covariates, from which the prior (four rows), the damage, rho and the tuples follow; only few rows reach the driver.
    """
    spark = bases.sparkSession
    rho, psi, out, last = [[0.0 if a == b else 1 / 3 for b in range(4)] for a in range(4)], [(k, d, 0.1 * exp(-0.2 * d) + 0.001) for k in (0, 1) for d in range(dists + 1)], [], None
    names = used(model)
    rows = bases.where("base < 4").select(*SITE, "ref", "base", "is_rev", *names, F.least("position", F.lit(dists)).alias("d5"), F.col("quality").alias("qual"))
    for t in range(max_iterations):
        by = {k: F.array(*(F.lit(float(p)) for kind, _, p in psi if kind == k)) for k in (0, 1)}
        damaged = F.when(F.col("is_rev") == 1, F.element_at(by[1], (F.col("d5") + 1).cast("int"))).otherwise(F.element_at(by[0], (F.col("d5") + 1).cast("int")))
        held, sites = inference.expected(rows.withColumns({"eps": rate(model), "psi": damaged}), substitution_table(*prior).tolist(), rho, names)
        by_ref = sites.groupBy("ref").agg(F.sum("ll").alias("ll"), *(F.sum(f"_p{i}").alias(f"_p{i}") for i in range(10))).collect()
        ll = float(sum(r["ll"] for r in by_ref))
        if last is not None and ll - last < min_delta_ll:
            break
        sums = stored(inference.summed(held, *names))
        last, psi = ll, sorted((r.kind, r.dist, r.psi) for r in _every_distance(inference.damage_mstep(sums), psi).collect())
        if fit_prior and by_ref:
            table = np.zeros((4, 10))
            for r in by_ref:
                table[r["ref"]] = [r[f"_p{i}"] for i in range(10)]
            prior = tuple(map(float, prior_mstep(table, np.array(prior))))
        for r in inference.rho_mstep(sums).collect():
            rho[r.was][r.read] = r.rho
        counts = sums.groupBy(*names).agg(F.sum("n").cast("double").alias("n"), F.sum(inference.misread()).alias("wrong"))
        model, _ = fitted(stored(counts), model, 3)
        at = {k: p for k, d, p in psi if d == 0}
        out.append((t, ll, at[0], at[1], *prior))
    return model, rho, spark.createDataFrame(out, "step int, ll double, psi_ct double, psi_ga double, mu double, theta_r double, theta_g double")


def _every_distance(new: DataFrame, before: list[tuple[int, int, float]]) -> DataFrame:
    """The new damage, and the one before at distances without bases."""
    old = new.sparkSession.createDataFrame(before, "kind int, dist long, _old double")
    return old.join(new, ["kind", "dist"], "left").select("kind", "dist", F.coalesce("psi", "_old").alias("psi"))
