"""The error model by covariates against numpy and planted parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import recalibration
from helixmill.operators.recalibration import COVARIATES, Model, Term

MODEL = Model(0.2, (Term("quality", "polynomial", (0.9, 0.01)), Term("mapping", "probit", (0.6, -1.0, 0.06)), Term("context", "empiric", (0.1, -0.2), (1, 4)), Term("position", "polynomial", (0.02,)), Term("fragment", "empiric", (0.0, 0.3, -0.1), (4, 6, 9))))
START = Model(0.0, (Term("quality", "polynomial", (1.0, 0.0)), Term("context", "empiric", (0.0, 0.0), (1, 4)), Term("position", "polynomial", (0.0,))))


def by_hand(model, row):
    """Error rate of a tuple of covariates."""
    eta = model.intercept
    for t in model.terms:
        v = row[list(COVARIATES).index(t.covariate)]
        if t.kind == "polynomial":
            if t.covariate == "quality":
                e = 10 ** (-v / 10)
                v = np.log(e / (1 - e))
            eta += sum(b * v ** (i + 1) for i, b in enumerate(t.betas))
        elif t.kind == "empiric":
            eta += t.betas[next((i for i, u in enumerate(t.upto) if v <= u), len(t.upto) - 1)]
        else:
            from math import erf, sqrt

            eta += t.betas[0] * (1 + erf((t.betas[1] + t.betas[2] * v) / sqrt(2))) / 2
    return 1 / (1 + np.exp(-eta))


def some_tuples(n, seed):
    rng = np.random.default_rng(seed)
    return np.unique(np.stack([rng.integers(0, m, n) for m in (5, 12, 61, 40, 40)], axis=1) + [0, 0, 0, 0, 2], axis=0).tolist()


def table(spark, model, n=800, seed=1):
    rows = [(*map(int, t), 1e6, 1e6 * float(by_hand(model, t))) for t in some_tuples(n, seed)]
    return spark.createDataFrame(rows, ", ".join(f"{c} int" for c in COVARIATES) + ", n double, wrong double")


def test_rates_by_hand(spark):
    rows = table(spark, MODEL).withColumn("eps", recalibration.rate(MODEL)).collect()
    assert [r.eps for r in rows] == pytest.approx([r.wrong / r.n for r in rows], rel=1e-9)
    far = spark.createDataFrame([(9, 99, 999, 999, 99)], ", ".join(f"{c} int" for c in COVARIATES)).withColumn("eps", recalibration.rate(MODEL)).first()
    assert 0 < far.eps < 1
    with pytest.raises(ValueError):
        recalibration.eta(Model(0.0, (Term("quality", "spline", (1.0,)),)))


def test_sums_are_derivatives(spark):
    """Gradient and Jacobian against differences of the expected log likelihood and of the gradient."""
    rows, at = table(spark, MODEL, 200).withColumn("wrong", F.col("wrong") * 1.3).cache(), MODEL.parameters()
    got, h = recalibration.newton_sums(rows, MODEL).first(), 1e-5

    def moved(i, d):
        p = at.copy()
        p[i] += d
        return recalibration.newton_sums(rows, MODEL.moved(p)).first()

    for i in (0, 1, 3, 4, 5, 7):
        up, down = moved(i, h), moved(i, -h)
        assert got[f"f{i}"] == pytest.approx((up["q"] - down["q"]) / (2 * h), rel=1e-3, abs=5)
        for j in (0, 3, 4, 5):
            key = f"j{min(i, j)}_{max(i, j)}"
            assert got[key] == pytest.approx((up[f"f{j}"] - down[f"f{j}"]) / (2 * h), rel=1e-3, abs=20)


def test_planted_parameters_are_found(spark):
    truth = START.moved(np.array([0.3, 0.85, 0.01, 0.15, -0.15, 0.03]))
    rows = table(spark, truth, 2000).cache()
    model, _ = recalibration.fitted(rows, START)
    assert [by_hand(model, t) for t in some_tuples(50, 9)] == pytest.approx([by_hand(truth, t) for t in some_tuples(50, 9)], rel=1e-5)
    p = model.parameters()
    assert (p[1], p[2], p[5], p[3] - p[4]) == pytest.approx((0.85, 0.01, 0.03, 0.3), abs=1e-5)
    curved = Model(0.0, (Term("mapping", "probit", (1.0, 0.0, 0.05)),))
    bent = table(spark, Model(-3.0, (Term("mapping", "probit", (2.0, -1.0, 0.08)),)), 400).cache()
    found, _ = recalibration.fitted(bent, curved, 60)
    rates = [(by_hand(found, (0, 0, m, 0, 9)), by_hand(Model(-3.0, (Term("mapping", "probit", (2.0, -1.0, 0.08)),)), (0, 0, m, 0, 9))) for m in range(0, 60, 7)]
    assert all(a == pytest.approx(b, rel=0.05) for a, b in rates)
    assert recalibration.fitted(rows.limit(0), START) == (START, 0.0)


def test_rates_by_group_and_mate_and_what_is_read(spark):
    rho = [[0.0, 0.2, 0.5, 0.3], [0.25, 0.0, 0.15, 0.6], [0.6, 0.1, 0.0, 0.3], [0.3, 0.4, 0.3, 0.0]]
    rows = [(1, 7, g, s, rev, b, 2, 3, 30, 4, 20) for g in "ab" for s in (0, 1) for rev in (0, 1) for b in (0, 1, 4)]
    df = spark.createDataFrame(rows, "chrom long, site long, rg string, is_second int, is_rev int, base int, context int, fragment int, mapping int, position int, quality int")
    got = recalibration.likelihoods(recalibration.with_rates(df, {("a", 0): MODEL}), {"a": rho}).first()
    logs = np.zeros(10)
    for _, _, g, s, rev, b, *c in rows:
        if b < 4:
            e = by_hand(MODEL, c) if (g, s) == ("a", 0) else 0.01
            turn = lambda x, rev=rev: 3 - x if rev else x
            p = [1 - e if k == b else e * (rho[turn(k)][turn(b)] if g == "a" else 1 / 3) for k in range(4)]
            logs += [np.log((p[x] + p[y]) / 2) for x, y in GENOTYPES]
    assert got.depth == 16 and list(got.logs) == pytest.approx(logs.tolist()) and max(got.gl) == 1


def test_estimation_climbs_and_stops(spark):
    rng, rows, truth = np.random.default_rng(4), [], Model(0.0, (Term("quality", "polynomial", (0.6,)), Term("position", "polynomial", (0.0,))))
    for site in range(1500):
        ref = int(rng.integers(4))
        held = ref if rng.random() > 0.1 else (ref + 2) % 4  # a tenth of the sites are substituted
        for _ in range(8):
            c = (int(rng.integers(5)), 5, 30, int(rng.integers(10)), int(rng.integers(10, 30)))
            base = held
            if rng.random() < by_hand(truth, c):
                base = (held + 2) % 4 if rng.random() < 0.8 else int((held + rng.choice([1, 3])) % 4)
            rows.append((1, site, ref, base, 0, *c))
    df = spark.createDataFrame(rows, "chrom long, site long, ref long, base long, is_rev int, context int, fragment int, mapping int, position int, quality int")
    start = Model(0.0, (Term("quality", "polynomial", (1.0,)),))
    model, rho, steps = recalibration.estimate(df, start, max_iterations=6, min_delta_ll=0.5)
    got = steps.orderBy("step").collect()
    lls = [r.ll for r in got]
    assert lls == sorted(lls) and len(lls) > 1
    assert by_hand(model, (0, 5, 30, 0, 20)) == pytest.approx(by_hand(truth, (0, 5, 30, 0, 20)), rel=0.25)
    assert all(sum(row) == pytest.approx(1) for row in rho) and rho[0][2] > 0.5
    assert 0.05 < got[-1].theta_r < 0.25 and got[-1].mu > 0.8
    assert recalibration.estimate(df, start, max_iterations=6, min_delta_ll=1e9)[2].count() == 1
