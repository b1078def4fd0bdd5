"""Estimates against brute force and planted parameters, and what becomes of mates by hand."""

import math
import random

import pytest

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import estimates, mates
from helixmill.operators.loci import PAIRS
from helixmill.operators.reads import downsample_reads, split_reads

GL = "chrom long, pos long, sample long, pop long, pl0 long, pl1 long, pl2 long, ploidy int"
AT = {g: i for i, g in enumerate(GENOTYPES)}


def normal(pl):
    raw = [10 ** (-x / 10) for x in pl]
    return [x / sum(raw) for x in raw]


def loci(rng, n, samples, haploid=0.3):
    return [(1, p, s, s % 2, *(rng.choice([0, 3, 9, 20, 60]) for _ in range(3)), 1 if rng.random() < haploid else 2) for p in range(n) for s in range(samples)]


def brute_interval(samples, below=14.0, interval=0.9):
    def log(f):
        f = min(max(f, 1e-16), 1 - 1e-16)
        one = lambda l, p: l[0] * (1 - f) + l[2] * f if p == 1 else l[0] * (1 - f) ** 2 + l[1] * 2 * f * (1 - f) + l[2] * f * f
        return round(-0.3 * math.log(f) - 0.3 * math.log(1 - f) + sum(math.log(one(l, p)) for l, p in samples), 9)

    first = [log(i / 100) for i in range(101)]
    near = [i for i, x in enumerate(first) if x >= max(first) - below]
    lo, hi = max(0, near[0] - 1) / 100, min(100, near[-1] + 1) / 100
    step = (hi - lo) / 1000
    logs = [log(lo + i * step) for i in range(1001)]
    d = [math.exp(x - max(logs)) for x in logs]
    need = interval * sum((a + b) / 2 for a, b in zip(d, d[1:], strict=False))
    l = r = best = d.index(max(d))  # noqa: E741
    held, low, high = 0.0, best, best
    while held < need and (l > 0 or r < 1000):
        left, right = d[l - 1] if l else -1, d[r + 1] if r < 1000 else -1
        mass = (right + d[r]) / 2 if right > left else (left + d[l]) / 2
        share = min(1, (need - held) / mass)
        if right > left:
            high, r = r + share, r + 1
        else:
            low, l = l - share, l - 1  # noqa: E741
        held += mass
    return [lo + x * step for x in (best, low, high)]


def test_credible_intervals(spark):
    rows = loci(random.Random(3), 12, 10)
    got = {(r.pos, r.pop): [r.map, r.low, r.high] for r in estimates.credible_intervals(spark.createDataFrame(rows, GL)).collect()}
    assert len(got) == 24
    for (pos, pop), out in got.items():
        want = brute_interval([(normal(r[4:7]), r[7]) for r in rows if (r[1], r[3]) == (pos, pop)])
        assert out == pytest.approx(want, abs=2e-6) and out[1] <= out[0] <= out[2]
    assert estimates.credible_intervals(spark.createDataFrame([], GL)).count() == 0


def brute_pair(samples, min_maf, least, most):
    """samples: (haploid, ten likelihoods) of a site."""
    def half(a, b):
        return sum(math.log((g[AT[a, a]] + g[AT[b, b]]) / 2 if one else g[AT[a, a]] / 4 + g[AT[a, b]] / 2 + g[AT[b, b]] / 4) for one, g in samples)

    k = max(range(6), key=lambda i: (round(half(*PAIRS[i]), 9), -i))
    a, b = PAIRS[k]
    hap = [(g[AT[a, a]], g[AT[b, b]]) for one, g in samples if one]
    dip = [(g[AT[a, a]], g[AT[a, b]], g[AT[b, b]]) for one, g in samples if not one]
    h1, d = 0.0, [0.0, 0.0, 0.0]
    if hap:
        x = [max(1e-6, sum(q[1] <= q[0] for q in hap) / len(hap)), max(1e-6, sum(q[1] > q[0] for q in hap) / len(hap))]
        h1 = x[1] / sum(x)
    if dip:
        x = [max(1e-6, sum(q.index(max(q)) == i for q in dip) / len(dip)) for i in range(3)]
        d = [v / sum(x) for v in x]
    maf = lambda: (lambda f: (f, min(f, 1 - f)))((len(dip) * (d[1] + 2 * d[2]) + len(hap) * h1) / (len(hap) + 2 * len(dip)))
    steps, state = 0, "rare" if maf()[1] < min_maf / 2 else "moving"
    while state == "moving" and steps < most:
        new_h, new_d = h1, d
        if hap:
            new_h = sum(q[1] * h1 / (q[0] * (1 - h1) + q[1] * h1) for q in hap) / len(hap)
        if dip:
            new_d = [sum(q[i] * d[i] / sum(x * y for x, y in zip(q, d, strict=True)) for q in dip) / len(dip) for i in range(3)]
        change = max(abs(new_h - h1), *(abs(x - y) for x, y in zip(d, new_d, strict=True)))
        h1, d, steps = new_h, new_d, steps + 1
        state = "rare" if maf()[1] < min_maf - change else "still" if change < least else "moving"
    ll = sum(math.log10(q[0] * (1 - h1) + q[1] * h1) for q in hap) + sum(math.log10(sum(x * y for x, y in zip(q, d, strict=True))) for q in dip)
    return k, *((b, a) if round(maf()[0], 9) >= 0.5 else (a, b)), maf()[1], ll, steps, state


@pytest.mark.parametrize("min_maf", [0.0, 0.2])
def test_pair_frequencies(spark, min_maf):
    rng, rows = random.Random(5), []
    for site in range(60):
        rare = site % 3 == 0
        for s in range(site % 9 + 1):
            g = [10 ** -rng.uniform(0, 4) for _ in range(10)]
            if rare:
                g[AT[1, 1]] = 30.0
            rows.append((1, site, s, 1 if (site % 4 == 0 or (site % 4 == 1 and s % 2)) else 2, [x / max(g) for x in g]))
    df = spark.createDataFrame(rows, "chrom long, site long, sample long, ploidy int, gl array<double>")
    full = {}
    for r in estimates.pair_frequencies(df, "sample", min_maf, 1e-6, 400).collect():
        want = brute_pair([(p == 1, g) for _, site, _, p, g in rows if site == r.site], min_maf, 1e-6, 400)
        assert (r.allele_pair, r.major, r.minor, r.steps, r.state) == (*want[:3], *want[5:])
        assert (r.maf, r.ll) == pytest.approx(want[3:5], abs=2e-6)
        full[r.site] = r
    assert len(full) == 60
    stopped = [r for r in full.values() if r.state == "rare"]
    assert bool(stopped) == (min_maf > 0) and all(r.maf < min_maf for r in stopped)


def test_a_planted_inbreeding_coefficient(spark):
    rng, rows, planted = random.Random(11), [], 0.35
    for pos in range(150):
        p = rng.uniform(0.2, 0.8)
        for s in range(25):
            a = int(rng.random() < p)
            gt = 2 * a if rng.random() < planted else a + int(rng.random() < p)
            rows.append((1, pos, s, 0, *((0 if k == gt else 50) for k in range(3)), 2))
    gl = spark.createDataFrame(rows, GL)
    got = estimates.inbreeding_fit(gl, steps=15).first()
    assert abs(got.f - planted) < 0.05 and got.ratio > 10 and got.monomorphic == 0 and got.rounds == 7  # a quarter of the bracket is left each round
    near = [estimates.inbreeding_loci(gl, f, 15).groupBy().sum("ll").first()[0] for f in (got.f - 0.01, got.f, got.f + 0.01)]
    assert max(near) == near[1]
    assert estimates.inbreeding_fit(spark.createDataFrame([], GL)).count() == 0


READS = "read_id long, name string, rg string, chrom long, pos long, len long, paired boolean, proper boolean, passed boolean"


def test_states_of_mates(spark):
    yes, no = True, False
    rows = [
        (1, "a", "g", 1, 100, 50, yes, yes, yes), (2, "a", "g", 1, 160, 50, yes, yes, yes),
        (3, "filtered first", "g", 1, 100, 50, yes, yes, no), (4, "filtered first", "g", 1, 160, 50, yes, yes, yes),
        (5, "filtered second", "g", 1, 100, 50, yes, yes, yes), (6, "filtered second", "g", 1, 160, 50, yes, yes, no),
        (7, "improper first", "g", 1, 100, 50, yes, no, yes), (8, "improper first", "g", 1, 160, 50, yes, yes, yes),
        (9, "improper, filtered first", "g", 1, 100, 50, yes, no, no), (10, "improper, filtered first", "g", 1, 160, 50, yes, yes, yes),
        (11, "far", "g", 1, 100, 50, yes, yes, yes), (12, "far", "g", 1, 2101, 50, yes, yes, yes),
        (13, "as far as may be", "g", 1, 100, 50, yes, yes, yes), (14, "as far as may be", "g", 1, 2100, 50, yes, yes, yes),
        (15, "three", "g", 1, 100, 50, yes, yes, yes), (16, "three", "g", 1, 160, 50, yes, yes, yes), (17, "three", "g", 1, 160, 50, yes, yes, yes),
        (18, "groups", "g", 1, 100, 50, yes, yes, yes), (19, "groups", "h", 1, 160, 50, yes, yes, yes),
        (20, "chromosomes", "g", 1, 100, 50, yes, yes, yes), (21, "chromosomes", "g", 2, 160, 50, yes, yes, yes),
        (22, "one", "g", 1, 100, 50, no, no, yes), (23, None, "g", 1, 100, 50, yes, yes, yes), (24, None, "g", 1, 100, 50, no, no, no),
        (25, "inside", "g", 1, 900, 50, yes, yes, yes), (26, "inside", "g", 1, 990, 50, yes, yes, yes), (27, "single inside", "g", 1, 990, 50, no, no, yes),
        (28, "no flag", "g", 1, 100, 50, yes, yes, None), (29, "no flag", "g", 1, 160, 50, yes, yes, yes),
    ]
    reads = spark.createDataFrame(rows, READS).repartition(3)
    state = lambda *more: {r.read_id: r.status for r in mates.mate_states(reads, *more).collect()}
    plain = {
        1: "pair", 2: "pair", 3: "filtered", 4: "poisoned", 5: "orphan", 6: "filtered", 7: "orphan", 8: "poisoned", 9: "filtered", 10: "orphan", 11: "orphan", 12: "orphan", 13: "pair", 14: "pair",
        15: "repeated", 16: "repeated", 17: "repeated", 18: "mismatch", 19: "mismatch", 20: "orphan", 21: "orphan", 22: "single", 23: "orphan", 24: "filtered", 25: "pair", 26: "pair", 27: "single",
        28: "filtered", 29: "poisoned",
    }
    assert state() == plain
    regions = spark.createDataFrame([(1, 1000, 1020)], "chrom long, start long, stop long")
    assert state(regions) == plain | {25: "masked", 26: "masked", 27: "masked"}  # a pair goes though one mate alone overlaps
    assert state(regions, True) == plain | dict.fromkeys((1, 2, 13, 14, 22), "masked")
    assert state(regions, False, 1.0) == plain and mates.mate_states(reads.limit(0), regions).count() == 0


def test_draws_by_any_name(spark):
    rows = spark.createDataFrame([(f"SRR1.{i}", i) for i in range(2000)] * 2, "name string, read_id long")
    kept = [r.name for r in split_reads(rows, [0.3]).where("part = 0").select("name").collect()]
    assert len(kept) == 2 * len(set(kept)) and 0.25 < len(kept) / 4000 < 0.35
    assert {r.n for r in downsample_reads(rows, [0.5]).groupBy("name").count().withColumnRenamed("count", "n").collect()} == {2}
