"""Fits that SQL can't express, against brute force."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import diversity, models, population
from helixmill.operators.sites import theta_prior
from helixmill.sources import views

GL = "chrom long, pos long, sample long, pop long, dp long, pl0 long, pl1 long, pl2 long, gt int"


def drawn_sites(spark, truth, freqs, n, seed, window=0):
    rng, rows = np.random.default_rng(seed), []
    for i, g in enumerate(rng.choice(10, n, p=theta_prior(truth, freqs))):
        gl = rng.random(10) * 1e-4
        gl[int(g)] = 1.0
        rows.append((1, window, i, [float(x) for x in gl]))
    return rows


def test_theta_and_frequencies_are_the_maximum(spark):
    truths = {0: (0.05, (0.4, 0.1, 0.2, 0.3)), 1: (0.2, (0.25, 0.25, 0.25, 0.25)), 2: (0.1, (0.25, 0.25, 0.25, 0.25))}
    rows = [r for w, (t, f) in truths.items() for r in drawn_sites(spark, t, f, 3000 if w < 2 else 20, w, w)]
    df = spark.createDataFrame(rows, "chrom long, win long, site long, gl array<double>")
    got = {r.win: r for r in diversity.theta(df, ["chrom", "win"], 25, 1e-5).collect()}
    assert got[2].n_sites == 20 and got[2].theta is None and got[2].half_width is None
    for w in (0, 1):
        gl = np.array([r[3] for r in rows if r[1] == w])
        pi = [got[w][f"pi{b}"] for b in range(4)]
        ll = lambda t, f, gl=gl: np.log(gl @ np.array(theta_prior(t, f))).sum()
        best = ll(got[w].theta, pi)
        assert best == pytest.approx(got[w].ll, abs=1e-3)
        assert all(best >= ll(got[w].theta * k, pi) for k in (0.8, 0.95, 1.05, 1.2))
        for b in range(4):
            moved = np.array(pi) * (1 - 0.02)
            moved[b] += 0.02
            assert best >= ll(got[w].theta, moved.tolist()) - 1e-6
        assert abs(got[w].theta - truths[w][0]) < 2 * got[w].half_width and got[w].het == pytest.approx((1 - np.exp(-got[w].theta)) * (1 - sum(x * x for x in pi)))
    whole = diversity.theta(df.where("win < 2"), []).collect()
    assert len(whole) == 1 and whole[0].n_sites == 6000 and got[0].theta < whole[0].theta < got[1].theta


def test_replicates_are_poisson(spark):
    sites = spark.range(4000).select(F.lit(1).cast("long").alias("chrom"), F.col("id").alias("site"), F.array(*(F.lit(0.1) for _ in range(10))).alias("gl"))
    got = {r.replicate: (r.n, r.m, r.v) for r in diversity.replicates(sites, 3, "chrom", "site").groupBy("replicate").agg(F.count("*").alias("n"), (F.sum("weight") / 4000).alias("m"), (F.sum(F.col("weight") * F.col("weight")) / 4000).alias("v")).collect()}
    assert got[0] == (4000, 1.0, 1.0) and len(got) == 4
    for k in (1, 2, 3):
        assert got[k][1] == pytest.approx(1, abs=0.08) and got[k][2] - got[k][1] ** 2 == pytest.approx(1, abs=0.15) and got[k][0] == pytest.approx(4000 * (1 - 1 / np.e), rel=0.05)


def test_saf_matches_a_sum_over_all_genotypes(spark):
    rows = [(1, 1, 0, 0, 5, 0, 10, 30, 0), (1, 1, 1, 0, 5, 20, 0, 25, 1), (1, 1, 2, 0, 5, 40, 12, 0, 2)]
    got = models.saf(spark.createDataFrame(rows, GL)).first()["saf"]
    want = np.zeros(7)
    for a in range(3):
        for b in range(3):
            for c in range(3):
                p = 1.0
                for g, r in zip((a, b, c), rows):
                    p *= 10 ** (-r[5 + g] / 10) * (2 if g == 1 else 1)
                want[a + b + c] += p
    want = np.log(want / [comb(6, j) for j in range(7)])
    assert got == pytest.approx((want - want.max()).tolist(), abs=1e-5)
    best = models.allele_counts_ml(models.saf(spark.createDataFrame(rows, GL))).first()
    assert best["n_alt"] == int(want.argmax()) and best["n_total"] == 6


def test_substitution_table():
    table = models.substitution_table(1 / 3, 1e-9, 0.02)
    assert table.sum(1) == pytest.approx(np.ones(4))
    same = [i for i, (a, b) in enumerate(GENOTYPES) if a == b]
    assert [int(np.argmax(table[r])) for r in range(4)] == same


def test_hky85_climbs(spark):
    rng = np.random.default_rng(1)
    table = models.substitution_table(0.5, 0.01, 0.05)
    rows = []
    for i in range(400):
        r = i % 4
        gl = [0.02] * 10
        gl[rng.choice(10, p=table[r])] = 1.0
        rows.append((1, i, r, gl))
    got = models.hky85(spark.createDataFrame(rows, "chrom int, site long, ref int, gl array<double>"), 4).orderBy("step").collect()
    assert all(a["ll"] <= b["ll"] + 1e-6 for a, b in zip(got, got[1:]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], GL)
    assert models.saf(none).count() == 0 and models.inbreeding_surface(none).count() == 0 and models.to_vcf(views.with_alleles(none), 2).count() == 0
    sites = spark.createDataFrame([], "chrom long, site long, ref int, gl array<double>")
    assert diversity.theta(sites.withColumn("win", F.lit(0)), ["win"]).count() == 0
    assert sum(r["freq"] for r in models.genotype_mixture(sites, 2).collect()) == 0


def test_exact_test_over_populations(spark):
    from itertools import product
    from math import factorial

    def chances(n, n_a):
        b = 2 * n - n_a
        return {h: 2**h * factorial(n) * factorial(n_a) * factorial(b) / factorial(2 * n) / factorial((n_a - h) // 2) / factorial(h) / factorial((b - h) // 2) for h in range(min(n_a, b) + 1) if (n_a - h) % 2 == 0}

    loci = {10: [(5, 4, 2), (6, 7, 3)], 20: [(5, 4, 0), (6, 7, 5), (3, 3, 1)], 30: [(4, 0, 0)], 40: [(7, 6, 4), (0, 0, 0)], 50: [(6, 7, 1), (5, 4, 4)]}
    rows = [(1, pos, p, *c) for pos, cs in loci.items() for p, c in enumerate(cs)]
    got = {r.pos: r for r in population.hwe_populations(spark.createDataFrame(rows, "chrom long, pos long, pop long, n long, n_a long, n_ab long")).collect()}
    assert set(got) == set(loci)
    for pos, cs in loci.items():
        cs = [c for c in cs if c[0]]
        seen, less, more = sum(c[2] for c in cs), 0.0, 0.0
        for hs in product(*(chances(n, a).items() for n, a, _ in cs)):
            p = np.prod([x for _, x in hs])
            less, more = less + p * (sum(h for h, _ in hs) <= seen), more + p * (sum(h for h, _ in hs) >= seen)
        assert (got[pos].p_less, got[pos].p_more) == pytest.approx((less, more), abs=2e-6) and got[pos].n_pops == len(cs)


def test_incomplete_beta(spark):
    cases = [(a, b, x) for a in (0.5, 1.0, 2.5, 10.0, 60.0) for b in (0.5, 1.0, 4.0, 30.0) for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.99, 1.0)]
    got = spark.createDataFrame(cases, "a double, b double, x double").withColumn("i", models.incomplete_beta(F.col("a"), F.col("b"), F.col("x"))).collect()
    for r in got:
        u = np.linspace(0, np.pi / 2, 200_001)  # t = sin^2 u takes the ends' poles away
        y = 2 * np.sin(u) ** (2 * r.a - 1) * np.cos(u) ** (2 * r.b - 1)
        y = np.nan_to_num(y, posinf=0)
        want = np.trapezoid(y[u <= np.arcsin(np.sqrt(r.x)) + 1e-12], u[u <= np.arcsin(np.sqrt(r.x)) + 1e-12]) / np.trapezoid(y, u)
        assert r.i == pytest.approx(want, abs=2e-4)


def test_association_over_populations(spark):
    rng, rows = np.random.default_rng(8), []
    traits = {s: float(rng.normal()) for s in range(24)}
    for pos in range(30):
        for s in range(24):
            g = int(traits[s] > 0.2) + int(traits[s] > -0.4) if pos == 0 else int(rng.integers(3))
            rows.append((1, pos, s, s % 2, *(0 if k == g else 30 for k in range(3))))
    gl = spark.createDataFrame(rows, "chrom long, pos long, sample long, pop long, pl0 long, pl1 long, pl2 long")
    df = spark.createDataFrame(list(traits.items()), "sample long, trait double")
    once = sorted(map(tuple, models.spearman_pooled(gl, df, 99).collect()))
    assert once == sorted(map(tuple, models.spearman_pooled(gl.repartition(3), df, 99).collect()))
    got = {r[1]: r for r in once}
    assert got[0][2:4] == (24, 2) and got[0][5] < 1e-3 and got[0][6] == pytest.approx(0.01)
    assert all((r[6] is None) == (r[5] >= 0.05) for r in once)
    flat = spark.createDataFrame([(s, 1.0 if s % 2 else t) for s, t in traits.items()], "sample long, trait double")
    assert {r.n_pops for r in models.spearman_pooled(gl, flat).collect()} == {1}
    assert models.spearman(gl, df.withColumn("trait", F.lit(1.0))).count() == 0 and models.spearman_pooled(gl, df.withColumn("trait", F.lit(1.0))).count() == 0
    assert all(abs(r[6] - r[5]) < 0.08 for r in once if r[6] is not None) and 0 < np.mean([r[5] for r in once[1:]]) < 0.8


def test_association_rounds_exact_halves_up(spark, monkeypatch):
    from fractions import Fraction

    from helixmill.plans import models as plans

    traits = [2, 2, 3, 4, 0, 0, 4, 4, 1, 1, 4, 2, 1, 4, 1, 2, 3, 2, 0, 0, 4, 3, 4, 2]
    loci = {1: [[2, 2, 2, 0, 0, 0], [2, 1, 1, 0, 1, 0]], 2: [[2, 0, 1, 1, 2, 0], [0, 2, 1]], 3: [[0, 0, 0, 2], [2, 0, 0, 1, 0, 1], [1, 0, 0, 0, 0]], 4: [[0, 1, 1, 1, 2, 2]]}

    def around(v):
        return [2 * sum(b < a for b in v) + sum(b == a for b in v) - len(v) for a in v]

    def exact(pops):
        e, n = Fraction(0), sum(map(len, pops))
        for p, gs in enumerate(pops):
            x, y = around(gs), around(traits[p :: 4][: len(gs)])
            e += (len(gs) - 1) * Fraction(sum(a * b for a, b in zip(x, y)) ** 2, sum(a * a for a in x) * sum(b * b for b in y))
        return e / (n - len(pops) - e) * (n - len(pops)) / len(pops)

    want = {pos: exact(pops) for pos, pops in loci.items()}
    assert [want[pos] for pos in (1, 2, 3)] == [Fraction(95, 32), Fraction(273, 160), Fraction(25, 32)]
    rows = [(1, pos, 4 * i + p, p, *(0 if k == g else 60 for k in range(3))) for pos, pops in loci.items() for p, gs in enumerate(pops) for i, g in enumerate(gs)]
    gl = spark.createDataFrame(rows, "chrom long, pos long, sample long, pop long, pl0 long, pl1 long, pl2 long")
    monkeypatch.setattr(plans, "_traits", lambda *_: spark.createDataFrame(list(enumerate(traits)), "sample long, trait long"))
    for given in (gl, gl.orderBy(F.desc("sample")), gl.repartition(3)):
        monkeypatch.setattr(views, "genotypes", lambda *_: given)
        got = {r.pos: r.f for r in plans.spearman_pooled(spark, "").collect()}
        assert got == {pos: float(Fraction(int(f * 10000 + Fraction(1, 2)), 10000)) for pos, f in want.items()}
