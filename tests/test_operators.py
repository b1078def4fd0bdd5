"""Operators on hand-made and random rows, against rules told in plain Python."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import inference, intervals, models, population, reads, selection, sites
from helixmill.operators.binned import previous
from helixmill.sources import files, readers

READ = "read_id long, name long, rg string, chrom long, pos long, len long, frag long, flag int"


def places(rows):
    return {(c, p) for c, a, b in rows for p in range(a, b)}


def runs(spots):
    out = []
    for c, p in sorted(spots):
        if out and out[-1][0] == c and out[-1][2] == p:
            out[-1][2] = p + 1
        else:
            out.append([c, p, p + 1])
    return sorted(map(tuple, out))


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_intervals_of_any_bin(spark, size):
    rng = random.Random(size)
    make = lambda n: [(rng.randint(1, 2), a := rng.randint(0, 180), a + rng.randint(1, 30)) for _ in range(n)]
    one, two = make(25), make(12)
    a, b = (spark.createDataFrame(x, "chrom long, start long, stop long") for x in (one, two))
    keys = ("chrom", "start", "stop")
    assert rows_of(intervals.bed_merge(a, size), *keys) == runs(places(one))
    assert rows_of(intervals.regions_except(a, b, size), *keys) == runs(places(one) - places(two))
    spots = spark.createDataFrame(sorted(places(two)), "chrom long, site long")
    assert rows_of(intervals.sites_to_intervals(spots, size), *keys) == runs(places(two))
    chroms = spark.createDataFrame([(1,), (2,), (3,)], "chrom long")
    rest = {(c, p) for c in (1, 2, 3) for p in range(220)} - places(one)
    assert rows_of(intervals.regions_complement(a, 220, chroms), *keys) == runs(rest)


def test_no_intervals(spark):
    none = spark.createDataFrame([], "chrom long, start long, stop long")
    chroms = spark.createDataFrame([(1,)], "chrom long")
    assert intervals.bed_merge(none).count() == 0 and intervals.regions_except(none, none).count() == 0
    assert rows_of(intervals.regions_complement(none, 9, chroms), "chrom", "start", "stop") == [(1, 0, 9)]


@pytest.mark.parametrize("size", [1, 10, 1000])
def test_previous_row_of_any_bin(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 300), i) for i in range(80)]
    df = previous(spark.createDataFrame(rows, "k string, pos long, i long"), ["k"], ["pos", "i"], F.col("i"), "before", size)
    want, last = set(), {}
    for k, p, i in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.add((k, p, i, last.get(k)))
        last[k] = i
    assert {tuple(r) for r in df.select("k", "pos", "i", "before").collect()} == want


def test_duplicates_skip_those_that_are_flagged(spark):
    rows = [
        (1, 1, "a", 1, 100, 50, 80, 0),
        (2, 2, "a", 1, 100, 50, 80, reads.DUPLICATE),  # flagged: stays, and is nobody's read before
        (3, 3, "a", 1, 101, 50, 78, 0),  # near 1 in start and fragment end
        (4, 4, "a", 1, 102, 50, 78, 0),  # near 3, which was just marked
        (5, 5, "a", 1, 102, 50, 60, 0),  # ends elsewhere
        (6, 6, "b", 1, 102, 50, 60, 0),  # of another group
        (7, 7, "a", 2, 102, 50, 60, 0),  # on another chromosome
        (8, 8, "a", 1, 70_000, 50, 60, 0),
    ]
    df = spark.createDataFrame(rows, READ)
    got = {r.read_id: r.is_dup for r in reads.mark_duplicates(df, 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0, 8: 0}
    assert {r.read_id for r in reads.mark_duplicates(df, 2, by_group=False).where("is_dup = 1").collect()} == {2, 3, 4, 6}
    assert reads.mark_duplicates(df.limit(0), 2).count() == 0


def test_quality_bins(spark):
    want = {0: 0, 1: 0, 2: 6, 9: 6, 10: 15, 19: 15, 20: 22, 24: 22, 25: 27, 29: 27, 30: 33, 34: 33, 35: 37, 38: 37, 39: 40, 93: 40}
    df = spark.createDataFrame([(q,) for q in want], "q int").select("q", selection.binned_quality(F.col("q")).alias("b"))
    assert {r.q: r.b for r in df.collect()} == want
    assert spark.range(1).select(selection.binned_quality(F.lit(2), 12, 30)).first()[0] == 15


def test_read_filters_stop_at_the_first(spark):
    row = {"read_id": 1, "name": 1, "rg": "a", "chrom": 1, "pos": 5, "len": 40, "frag": 90, "flag": 3, "mapq": 30, "clip_left": 0, "clip_right": 0, "tlen": 90, "ds": None}
    cases = [({}, None), ({"len": 700, "flag": 1024}, "MappedLength"), ({"flag": 1024 | 512}, "Duplicate"), ({"clip_left": 60}, "SoftClipped"), ({"ds": 5.0}, "PMDS"), ({"ds": 3.0}, None), ({"flag": 1}, "ImproperPairs"), ({"flag": 4 | 512}, "Unmapped"), ({"name": 9}, "Blacklist"), ({"mapq": 1, "name": 9}, "MappingQuality"), ({"frag": 500}, "FragmentLength"), ({"tlen": -39}, "LongerThanFragment"), ({"tlen": 5, "flag": 0}, None), ({"pos": 6}, "External")]
    schema = READ + ", mapq long, clip_left long, clip_right long, tlen long, ds double, i int"
    df = spark.createDataFrame([tuple({**row, **c, "i": i}[f.split()[0]] for f in schema.split(", ")) for i, (c, _) in enumerate(cases)], schema)
    names = spark.createDataFrame([(9,), (9,)], "name long")
    got = reads.read_filter(df, mapq=(10, 50), soft_clip=0.3, pmds=4.0, blacklist=names, fragment=(0, 400), longer_than_fragment=True, external=F.col("pos") == 5)
    assert [r.reason for r in got.orderBy("i").collect()] == [w for _, w in cases]


def test_overlapping_mates(spark):
    schema = "name long, rg string, chrom long, status string, pos1 long, len1 long, pos2 long, len2 long, rev1 int, rev2 int"
    rows = [(1, "a", 1, "pair", 10, 10, 15, 10, 0, 1), (2, "a", 1, "pair", 15, 10, 10, 10, 1, 0), (3, "a", 1, "pair", 10, 5, 15, 5, 0, 1), (4, "a", 1, "pair", 10, 9, 15, 9, 0, 0), (5, "a", 1, "pair", 20, 9, 15, 9, 0, 1), (6, "a", 1, "pair", 10, 90, 15, 9, 0, 1)]
    df = spark.createDataFrame(rows, schema)
    got = lambda m: {r.name: (r["class"], r.f_clip, r.r_clip) for r in reads.merge_overlapping_mates(df, m).collect()}
    rest = {3: ("no_overlap", 0, 0), 4: ("both_forward", 0, 0), 5: ("rev_starts_first", 0, 0), 6: ("rev_ends_first", 0, 0)}
    assert got("middle") == {1: ("overlap", 3, 2), 2: ("overlap", 2, 3), **rest}
    assert got("keepFirst") == {1: ("overlap", 0, 5), 2: ("overlap", 5, 0), **rest}
    assert got("keepRev") == {1: ("overlap", 5, 0), 2: ("overlap", 5, 0), **rest}
    assert all(f + r == 5 and 0 in (f, r) for c, f, r in got("random").values() if c == "overlap")


def test_thinned_loci(spark):
    rng = random.Random(3)
    for d in (1, 20, 5000):
        spots = {(c, rng.randint(0, 3000) + 70_000 * rng.randint(0, 1)) for c in (1, 2) for _ in range(120)}
        want, last = [], {}
        for c, p in sorted(spots):
            if c not in last or p - last[c] >= d:
                want.append((c, p))
                last[c] = p
        assert rows_of(population.thin_loci(spark.createDataFrame(sorted(spots), "chrom long, pos long"), d), "chrom", "pos") == want


def test_full_grid_makes_places_in_blocks(spark):
    pile = spark.createDataFrame([(1, 3, 7), (2, 9, 1)], "chrom long, site long, depth long")
    got = rows_of(selection.full_grid(pile, spark.createDataFrame([(1,), (2,)], "chrom long"), 10, 4), "chrom", "site", "depth")
    assert got == [(c, s, {(1, 3): 7, (2, 9): 1}.get((c, s), 0)) for c in (1, 2) for s in range(10)]


def test_fasta_over_splits(spark):
    rng = random.Random(1)
    path, rows = files.scratch(spark), [(c, s, rng.randint(0, 3)) for c in ("1", "chrX") for s in range(1500) if rng.random() < 0.9]
    readers.write_fasta(spark.createDataFrame(rows, "chrom string, site long, ref long"), path, 50)
    known = {(c, s): r for c, s, r in rows}
    want = [(c, s, known.get((c, s), 4)) for c in ("1", "chrX") for s in range(max(x for y, x, _ in rows if y == c) + 1)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "700b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert rows_of(readers.read_fasta(spark, path), "chrom", "site", "ref") == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    odd = files.scratch(spark)
    spark.createDataFrame([(">chr3 x\nacGTn\r\n\n-T\n>chr4\n",)], "value string").coalesce(1).write.text(odd)
    assert rows_of(readers.read_fasta(spark, odd), "chrom", "site", "ref") == [("chr3", i, b) for i, b in enumerate((0, 1, 2, 3, 4, 4, 3))]


def test_calls_by_format(spark):
    lines = [
        "##fileformat=VCFv4.2",
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tx\ty\tz",
        "chr1\t10\t.\tA\tC\t.\t.\t.\tGT:DP:PL\t0/1:7:10,0,30\t./.\t1|1",
        "chr1\t11\t.\tA\tC,G\t.\t.\t.\tGT\t0/1\t0/2\t1/1",
        "chr2\t12\t.\tA\t.\t.\t.\t.\tPL:GQ:GT:AD\t.:9:0/0:3,4\t1,2,3:.:.\t.",
        "chr2\t13\t.\tG\tT\t.\t.\t.\tGL:GT\t-0.5,0,-1.25:0/1\t.\t.",
    ]
    path = files.scratch(spark)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    got = {(r.chrom, r.pos, r.sample): (r.gt, r.dp, r.gq, r.ad, r.pl0, r.pl1, r.pl2) for r in readers.read_vcf(spark, path).collect()}
    assert got == {
        ("chr1", 10, "x"): (1, 7, None, None, 10, 0, 30),
        ("chr1", 10, "z"): (2, None, None, None, None, None, None),
        ("chr2", 12, "x"): (0, None, 9, [3, 4], None, None, None),
        ("chr2", 12, "y"): (None, None, None, None, 1, 2, 3),
        ("chr2", 13, "x"): (1, None, None, None, 5, 0, 13),
    }


def test_lists(spark):
    def text(*lines):
        path = files.scratch(spark)
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
        return path

    assert rows_of(readers.read_bed(spark, text("#c", "track x", "chr1\t5\t9\tan info", "", "2 7 8"), True), "chrom", "start", "stop") == [("2", 7, 8), ("chr1", 5, 9)]
    assert rows_of(readers.read_samples(spark, text("b p", "a", "c q"), "all"), "place", "sample", "pop") == [(0, "b", "p"), (1, "a", "all"), (2, "c", "q")]
    assert rows_of(readers.read_blacklist(spark, text("r1 x", "r1", "", " r2")), "name") == [("r1",), ("r2",)]
    traits = text("id\tsex\theight", "a\tm\t1.5", "b\tf\tNA")
    assert rows_of(readers.read_phenotype(spark, traits, "height"), "sample", "trait") == [("a", 1.5)]
    assert readers.read_phenotype(spark, traits).count() == 0
    with pytest.raises(ValueError):
        readers.read_phenotype(spark, traits, "weight")
    counts = text("chr\tpos\tref\talt\tp\tq", "chr1\t5\tA\tC\t1/4\t0/0")
    assert rows_of(readers.read_count_table(spark, counts), "chrom", "pos", "pop", "n_minor", "n_total") == [("chr1", 5, "p", 1, 4)]


def test_pools_must_agree(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "rg string")
    good = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "x")], "rg string, pool string")
    assert rows_of(selection.pooled_groups(rows, good), "rg", "pool") == [("a", "x"), ("b", "x"), ("c", "c")]
    with pytest.raises(Exception, match="two pools"):
        selection.pooled_groups(rows, good.unionByName(spark.createDataFrame([("a", "y")], "rg string, pool string"))).collect()


# models


def test_allele_counts_grow_with_the_square_of_samples(spark):
    def seconds(n):
        rows = [(1, p, s, 0, 5, 0, 10, 0, 30, 0) for p in range(40) for s in range(n)]
        df = spark.createDataFrame(rows, "chrom long, pos long, sample long, pop long, dp long, ad long, pl0 long, pl1 long, pl2 long, gt int").repartition(1).persist()
        df.count()
        began = time.time()
        assert all(len(r.saf) == 2 * n + 1 for r in models.saf(df).collect())
        return time.time() - began

    seconds(10)
    short, long = seconds(40), seconds(80)
    assert long < 4 * short + 2


def test_counts_over_three_minors(spark):
    from math import comb

    rng = np.random.default_rng(2)
    rows = [(1, s, s % 4, x, [float(v) for v in rng.uniform(0.01, 1, 10)]) for s in range(6) for x in ("a", "b", "c") if (s, x) != (2, "b")]
    got = {r.site: r for r in inference.saf(spark.createDataFrame(rows, "chrom long, site long, ref long, sample string, gl array<double>"), "sample", 3).collect()}
    index = {g: i for i, g in enumerate(GENOTYPES)}
    for s, r in got.items():
        gls = [g for _, t, _, _, g in rows if t == s] + [[1.0] * 10] * (s == 2)
        total, a = np.zeros(7), s % 4
        for b in range(4):
            if b != a:
                h = np.ones(1)
                for g in gls:
                    h = np.convolve(h, [g[index[a, a]], 2 * g[index[min(a, b), max(a, b)]], g[index[b, b]]])
                total += h
        want = np.log(total / [comb(6, j) for j in range(7)])
        assert r.lower == 0 and r.saf == pytest.approx((want - want.max()).tolist(), abs=1e-5)


def test_genotype_classes():
    count = [0] * 9
    for k, *_ in inference.class_terms():
        count[k] += 1
    assert count == [4, 12, 12, 12, 6, 24, 12, 12, 6]
    assert inference.genotype_class((0, 0), (0, 0)) == 0 and inference.genotype_class((0, 1), (2, 3)) == 8 and inference.genotype_class((0, 1), (1, 2)) == 5


def test_distance_of_equal_and_of_unlike_samples(spark):
    rows = []
    for s in range(300):
        for name, g in (("a", s % 10), ("b", s % 10), ("c", (s * 7 + 3) % 10)):
            gl = [1e-6] * 10
            gl[g] = 1.0
            rows.append((1, s, name, gl))
    got = {(r.s1, r.s2): r for r in inference.genetic_distance(spark.createDataFrame(rows, "chrom long, site long, sample string, gl array<double>"), "sample", 3).collect()}
    assert got["a", "b"].squared < 1e-3 < 1 < got["a", "c"].squared
    assert got["a", "c"].euclidean == pytest.approx(got["a", "c"].squared ** 0.5, abs=1e-5)


def test_newton_finds_a_planted_error_model():
    q = np.arange(5, 45)
    raw = 10 ** (-q / 10)
    eps = 1 / (1 + np.exp(-(0.3 + 0.8 * np.log(raw / (1 - raw)))))
    a, b, ll = inference.epsilon_newton([(int(x), 1e6, 1e6 * e) for x, e in zip(q, eps)], 0.0, 1.0, 20)
    assert (a, b) == pytest.approx((0.3, 0.8), abs=1e-6)
    assert ll >= inference.epsilon_newton([(int(x), 1e6, 1e6 * e) for x, e in zip(q, eps)], 0.0, 1.0, 1)[2]
    assert inference.epsilon_newton([], 0.1, 0.9) == (0.1, 0.9, 0.0)


def test_error_model_climbs_and_finds_the_damage(spark):
    rng = np.random.default_rng(9)
    rows = []
    for site in range(3000):
        ref = int(rng.integers(4))
        for _ in range(6):
            d5, q, base = int(rng.integers(0, 8)), 30, ref
            if base == 1 and rng.random() < (0.3 if d5 == 0 else 0.01):
                base = 3
            if rng.random() < 0.001:
                base = int((base + rng.integers(1, 4)) % 4)
            rows.append((1, site, ref, base, q, 0, d5))
    got = inference.estimate_errors(spark.createDataFrame(rows, "chrom long, site long, ref long, base long, qual long, is_rev int, d5 long"), iterations=4).orderBy("step").collect()
    lls = [r.ll for r in got]
    assert lls == sorted(lls) and got[-1].psi_ct == pytest.approx(0.3, abs=0.06)


def test_hky85_finds_planted_parameters(spark):
    rng = np.random.default_rng(5)
    truth = (0.6, 0.02, 0.05)
    table, rows = models.substitution_table(*truth), []
    for i in range(8000):
        gl = [1e-6] * 10
        gl[int(rng.choice(10, p=table[i % 4]))] = 1.0
        rows.append((1, i, i % 4, gl))
    got = models.hky85(spark.createDataFrame(rows, "chrom long, site long, ref int, gl array<double>"), 20).orderBy("step").collect()[-1]
    assert (got.mu, got.theta_r, got.theta_g) == pytest.approx(truth, rel=0.35)


def test_ratio_of_thetas(spark):
    rng, rows = np.random.default_rng(6), []
    for region, theta in ((1, 0.1), (2, 0.02)):
        for i, g in enumerate(rng.choice(10, 6000, p=sites.theta_prior(theta))):
            gl = [1e-6] * 10
            gl[int(g)] = 1.0
            rows.append((region, i, gl))
    df = spark.createDataFrame(rows, "region int, site long, gl array<double>")
    r = inference.theta_ratio(df, points=61)
    assert r.first()["mean"] == pytest.approx(np.log(5), abs=0.4) and r.first()["p_above"] > 0.99
    assert inference.theta_ratio(df.where("region = 1")).count() == 0


def test_haploid_likelihoods(spark):
    rows = [(1, 1, 5, 0, 0, 0, 20), (2, 1, 5, 0, 0, 1, 30), (3, 1, 5, 0, 0, 4, 30)]
    got = sites.haploid_likelihoods(spark.createDataFrame(rows, "read_id long, chrom int, site long, off long, ref int, base int, qual int")).first()
    want = np.array([0.99 * 0.001 / 3, 0.999 * 0.01 / 3, 0.01 / 3 * 0.001 / 3, 0.01 / 3 * 0.001 / 3])
    assert got.gl == pytest.approx((want / want.max()).tolist()) and got.depth == 2


def test_lift_over(spark):
    rows = [("a_7_x", 1, 100, 10, 3, 2), ("a_2_y", 1, 100, 10, 3, 2), ("a_13_z", 1, 100, 10, 3, 2)]
    from helixmill.operators import loci

    got = loci.lifted(spark.createDataFrame(rows, "name string, chrom long, pos long, len long, clip_left long, clip_right long"))
    assert rows_of(got, "info", "chrom", "site") == [("x", 1, 104)]
