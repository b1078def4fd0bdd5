"""What deep sites, many copies and large sums must not change. Each test stands for a run on larger tables that failed."""

import math

import pytest
from pyspark.sql import functions as F

from helixmill.operators import estimates, inference, population, reads, selection
from helixmill.plans import inference as plans

SF = "/root/testdata/sf0.001"
LOCUS = "chrom long, pos long, sample long, pop long, pl0 long, pl1 long, pl2 long"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("step", [inference.damage_mstep, inference.rho_mstep, inference.error_counts])
def test_bases_are_summed_where_they_are_and_both_joins_agree(spark, monkeypatch, step):
    near = step(plans._held(spark, SF))
    assert "Exchange hashpartitioning(chrom" not in plan_of(near)
    monkeypatch.setattr(inference, "FEW_SITES", 0)
    far = step(plans._held(spark, SF))
    key = [c for c in near.columns if c not in ("psi", "rho", "wrong")]
    rows = lambda df: {tuple(r[c] for c in key): [v for c, v in r.asDict().items() if c not in key] for r in df.collect()}
    got, want = rows(near), rows(far)
    assert got.keys() == want.keys() and len(got) > 5
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in got)


def test_pairs_of_samples_far_from_each_other(spark):
    """Three deep samples of three alleles: every pair is impossible for one of them, in doubles."""
    logs = lambda g: [0.0 if i == g else -2000.0 - i for i in range(10)]
    rows = [(1, 1, 0, s, logs(g)) for s, g in enumerate((0, 4, 7))]
    df = spark.createDataFrame(rows, "chrom long, site long, ref long, s long, logs array<double>").withColumn("gl", F.transform("logs", lambda x: F.exp(x)))
    got = inference.major_minor_mle(df, "s", 3).collect()
    assert len(got) == 1 and {got[0].major, got[0].minor} == {0, 1}
    assert math.isfinite(got[0].ll) and got[0].ll == pytest.approx(-2000 / math.log(10), rel=1e-2)


def test_haploid_samples_whose_alleles_are_both_unlikely(spark):
    df = spark.createDataFrame([(1, 1, 0, 0, 4000, 0, 4000, 1), (1, 1, 1, 0, 5000, 0, 4000, 1)], LOCUS + ", ploidy int")
    assert population.allele_freq_mixed(df, 1).first().freq == 0.75


def test_inbreeding_of_deep_heterozygotes(spark):
    df = spark.createDataFrame([(1, 1, s, 0, 4000, 0, 4000) for s in range(4)], LOCUS)
    got = estimates.inbreeding_fit(df, points=3, steps=3).first()
    assert got.f < 0.001 and got.monomorphic == 0 and math.isfinite(got.ll)


def test_likelihood_of_one_allele_below_the_least_double(spark):
    df = spark.createDataFrame([(1, 1, s, 0, 4000, 0, 4000) for s in range(4)], LOCUS)
    assert estimates.inbreeding_loci(df, 0.1, 3).first().monomorphic is False


def test_correlation_of_more_bases_than_products_of_64_bits(spark, monkeypatch):
    df = spark.createDataFrame([("A", 10, 0), ("A", 20, 1), ("A", 40, 2)], "rg string, qual long, off long")
    few = {(r.q1, r.q2): r.r2 for r in selection.quality_transformation(df).collect()}
    monkeypatch.setattr(selection.F, "count", lambda _: F.lit(0).cast("long") + F.sum(F.lit(10**10).cast("long")))
    many = {(r.q1, r.q2): r.r2 for r in selection.quality_transformation(df).collect()}
    assert few == many and None not in few.values()


def test_covariates_of_bases_at_deep_sites_without_moving_bases(spark):
    rows = [(1, 5, "A", 10, 0, 1, 30, 2), (1, 5, "N", 11, 1, 2, 31, 3), (1, 6, "A", 10, 2, 1, 30, 2), (2, 5, "N", 12, 0, 2, 31, 0), (2, 9, "A", 12, 0, 2, 31, 0), (2, 9, "A", 12, 0, 2, 31, 0)]
    df = spark.createDataFrame(rows, "chrom long, site long, rg string, qual long, off long, mapq long, len long, base long")
    table = selection.covariate_table(df)
    assert "LeftSemi" not in plan_of(table)
    got = {(r.rg, r.covariate, r.value): r.n for r in table.collect()}
    deep = [r for r in rows if sum(x[:2] == r[:2] for x in rows) > 1]
    want = {}
    for r in deep:
        for c, v in zip(("qual", "off", "mapq", "len", "base"), r[3:], strict=True):
            want[r[2], c, v] = want.get((r[2], c, v), 0) + 1
    assert got == want


def overlapping(spark):
    regions = spark.range(400).selectExpr("1L AS chrom", "10 * (id % 20) + 2000 * (id div 200) AS start", "10 * (id % 20) + 2000 * (id div 200) + 5 + id % 7 AS stop")
    own = spark.createDataFrame([(1, 1, 0, 20), (2, 1, 300, 20), (3, 1, 195, 4), (4, 1, 1990, 20), (5, 1, 1980, 20), (6, 2, 0, 20)], "read_id long, chrom long, pos long, len long")
    return own, regions


def test_reads_meet_merged_intervals(spark):
    own, regions = overlapping(spark)
    got = reads.reads_x_regions(own, regions)
    assert {r.read_id for r in got.collect()} == {1, 3, 4} and "max(stop" in plan_of(got)


def test_reads_outside_of_many_overlapping_intervals(spark):
    own, regions = overlapping(spark)
    got = selection.read_mask(own, regions)
    assert {r.read_id for r in got.collect()} == {2, 5, 6} and "max(stop" in plan_of(got)
