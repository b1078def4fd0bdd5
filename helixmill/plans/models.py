"""Queries of fitted models and conversions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import diversity, models, population, sites
from helixmill.operators.reads import downsample_reads
from helixmill.plans import sql
from helixmill.plans.registry import WIN, query
from helixmill.sources import views

_PSI = "(0.2 * exp(-0.3 * off) + 0.01)"
_EPS = "pow(10.0, -qual / 10)"
_IN = [f"(CASE WHEN base = {b} THEN 1 - {_EPS} ELSE {_EPS} / 3 END)" for b in range(4)]
_OUT = [f"((1 - {_PSI}) * {_IN[1]} + {_PSI} * {_IN[3]})" if b == 1 else _IN[b] for b in range(4)]


def _likelihoods(s, d):
    return sites.genotype_likelihoods(views.bases(s, d))


def _mixture(steps: int) -> str:
    text = f"WITH {sql.LIKELIHOODS}, p0 AS (SELECT {', '.join(f'CAST(0.1 AS DOUBLE) AS p{i}' for i in range(10))})"
    total = " + ".join(f"gl[{i + 1}] * p{i}" for i in range(10))
    for t in range(steps):
        text += f", q{t} AS (SELECT {', '.join(f'sum(gl[{i + 1}] * p{i} / ({total})) AS s{i}' for i in range(10))} FROM sites, p{t})"
        text += f", p{t + 1} AS (SELECT {', '.join(f's{i} / ({chr(43).join(f"s{k}" for k in range(10))}) AS p{i}' for i in range(10))} FROM q{t})"
    return text + " " + " UNION ALL ".join(f"SELECT {i} AS genotype, round(p{i}, 6) AS freq FROM p{steps}" for i in range(10))


@query(_mixture(3))
def haplo_diplo_mixture(s, d):
    return models.genotype_mixture(_likelihoods(s, d), 3)


_HKY = (0.5, 0.001, 0.01)
_PI = "CASE ref " + " ".join(f"WHEN {r} THEN [{', '.join(repr(x) for x in row)}]" for r, row in enumerate(models.substitution_table(*_HKY).tolist())) + " END"


@query(
    f"WITH {sql.LIKELIHOODS}, w AS (SELECT chrom, site, ref, gl, {_PI} AS pi FROM sites), v AS (SELECT chrom, site, ref, [{', '.join(f'gl[{i + 1}] * pi[{i + 1}]' for i in range(10))}] AS w FROM w), "
    "p AS (SELECT chrom, site, ref, list_transform(w, lambda x: x / list_sum(w)) AS p FROM v) "
    f"SELECT chrom, site, ref, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS genotype, round({' + '.join(f'p[{i + 1}]' for i, (a, b) in enumerate(GENOTYPES) if a != b)}, 6) AS p_het FROM p"
)
def hky85_posterior(s, d):
    return models.hky85_posterior(_likelihoods(s, d), *_HKY)


@query()
def hky85(s, d):
    return models.hky85(_likelihoods(s, d), 30, 1e-3)


def _windows(s, d):
    return _likelihoods(s, d).withColumn("win", F.expr(f"site div {WIN}"))


def _tidy(rows):
    return rows.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query()
def theta(s, d):
    return diversity.theta(_windows(s, d), ["chrom", "win"], min_sites=100)


@query()
def theta_genome(s, d):
    """Of all sites as one, by the same steps."""
    return diversity.theta(_likelihoods(s, d), [])


@query()
def theta_bootstrap(s, d):
    return diversity.theta(diversity.replicates(_windows(s, d), 5, "chrom", "site"), ["chrom", "win", "replicate"], min_sites=100)


@query()
def theta_downsample(s, d):
    """Theta of each window from the reads kept at each of two probabilities, in one pass over the reads."""
    kept = downsample_reads(views.reads(s, d), [0.5, 0.2])
    rows = views.explode_bases(kept.select("read_id", "chrom", "pos", "len", "k", "p"))
    rows = rows.withColumn("base", F.expr("CASE WHEN (k * 31 + off * 17 + chrom) % 29 = 0 THEN (ref + 1 + (k + off) % 3) % 4 ELSE ref END")).withColumn("qual", F.expr("12 + (k * 7 + off * 3) % 30"))
    return diversity.theta(sites.genotype_likelihoods(rows, "p").withColumn("win", F.expr(f"site div {WIN}")), ["chrom", "win", "p"], min_sites=100)


_P = [f"pi{a} * (e + pi{a} * (1 - e))" if a == b else f"2 * pi{a} * pi{b} * (1 - e)" for a, b in GENOTYPES]
_HOM = [GENOTYPES.index((b, b)) for b in range(4)]


def _theta_steps(steps: int, inner: int) -> str:
    """The SQL of steps, each with its draws counted ``inner`` times, for all windows and for all sites as window -1."""
    freq = ", ".join(f"avg(({' + '.join(f'{g.count(b)} * gl[{i + 1}]' for i, g in enumerate(GENOTYPES) if b in g)}) / (2 * list_sum(gl))) AS f{b}" for b in range(4))
    text = f"WITH {sql.LIKELIHOODS}, s AS (SELECT chrom, site // {WIN} AS win, gl FROM sites UNION ALL SELECT 0, -1, gl FROM sites), f AS (SELECT chrom, win, count(*) AS n_sites, {freq} FROM s GROUP BY ALL), "
    text += f"p0 AS (SELECT chrom, win, n_sites, exp(-0.01) AS e, {', '.join(f'greatest(1e-6, f{b}) / (greatest(1e-6, f0) + greatest(1e-6, f1) + greatest(1e-6, f2) + greatest(1e-6, f3)) AS pi{b}' for b in range(4))} FROM f)"
    for t in range(steps):
        text += f", w{t} AS (SELECT s.chrom, s.win, [{', '.join(f'gl[{i + 1}] * ({p})' for i, p in enumerate(_P))}] AS w FROM s JOIN p{t} p ON s.chrom = p.chrom AND s.win = p.win)"
        text += f", q{t} AS (SELECT chrom, win, sum(ln(list_sum(w))) AS ll, {', '.join(f'sum(w[{i + 1}] / list_sum(w)) AS s{i}' for i in range(10))} FROM w{t} GROUP BY ALL)"
        text += f", m{t}_0 AS (SELECT q.*, n_sites, e, pi0, pi1, pi2, pi3 FROM q{t} q JOIN p{t} p ON q.chrom = p.chrom AND q.win = p.win)"
        for k in range(inner):
            one = ", ".join(f"s{h} * e / (e + pi{b} * (1 - e)) AS o{b}" for b, h in enumerate(_HOM))
            draws = [f"(2 * s{h} - o{b} + {' + '.join(f's{i}' for i, g in enumerate(GENOTYPES) if b in g and g[0] != g[1])})" for b, h in enumerate(_HOM)]
            text += f", o{t}_{k} AS (SELECT *, {one} FROM m{t}_{k}), m{t}_{k + 1} AS (SELECT chrom, win, ll, n_sites, {', '.join(f's{i}' for i in range(10))}, (o0 + o1 + o2 + o3) / ({' + '.join(f's{i}' for i in range(10))}) AS e, {', '.join(f'{x} / ({" + ".join(draws)}) AS pi{b}' for b, x in enumerate(draws))} FROM o{t}_{k})"
        text += f", p{t + 1} AS (SELECT chrom, win, n_sites, e, pi0, pi1, pi2, pi3, ll FROM m{t}_{inner})"
    return text + f" SELECT chrom, win, n_sites, round(-ln(e), 6) AS theta, round((1 - e) * (1 - pi0 * pi0 - pi1 * pi1 - pi2 * pi2 - pi3 * pi3), 6) AS het, round(pi0, 6) AS pi0, round(pi1, 6) AS pi1, round(pi2, 6) AS pi2, round(pi3, 6) AS pi3, round(ll, 3) AS ll FROM p{steps}"


@query(_theta_steps(3, 2))
def theta_steps(s, d):
    """Three steps from a theta of 0.01, of each window and of the genome (window -1)."""
    rows = _windows(s, d).select("chrom", "win", "gl")
    rows = rows.unionByName(rows.select(F.lit(0).cast("long").alias("chrom"), F.lit(-1).cast("long").alias("win"), "gl"))
    got = diversity.theta(rows, ["chrom", "win"], 3, 0.0, 2, 1, 0.01)
    return _tidy(got.drop("half_width", "ll")).join(got.select("chrom", "win", F.round("ll", 3).alias("ll")), ["chrom", "win"])



@query()
def saf_biallelic(s, d):
    return models.saf(views.genotypes(s, d)).select("chrom", "pos", "pop", F.array_join(F.transform("saf", lambda x: (x + 0.0).cast("decimal(14,6)").cast("string")), ",").alias("saf"))


@query()
def allele_counts_ml(s, d):
    return models.allele_counts_ml(models.saf(views.genotypes(s, d)))


def _gf(steps: int) -> str:
    text, before = f"WITH {sql.NORMAL}, f0 AS (SELECT DISTINCT chrom, pos, pop, {', '.join(f'1.0::DOUBLE / 3 AS p{k}' for k in range(3))} FROM normal)", "f0"
    total = "(l0 * p0 + l1 * p1 + l2 * p2)"
    for t in range(1, steps + 1):
        text += f", f{t} AS (SELECT chrom, pos, pop, {', '.join(f'sum(l{k} * p{k} / {total}) / count(*) AS p{k}' for k in range(3))} FROM normal JOIN {before} USING (chrom, pos, pop) GROUP BY ALL)"
        before = f"f{t}"
    return text + f" SELECT chrom, pos, pop, {', '.join(f'round(p{k}, 6) AS f{k}' for k in range(3))} FROM {before}"


@query(_gf(3))
def allele_freq_gf(s, d):
    return models.genotype_frequencies(views.genotypes(s, d), 3)


_POST = (
    f"WITH {sql.NORMAL}, grid AS (SELECT range AS i, (range + 0.5) / 21 AS f FROM range(0, 21)), "
    "l AS (SELECT chrom, pos, pop, i, any_value(-0.3 * ln(f * (1 - f))) + sum(ln(l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)) AS l FROM normal, grid GROUP BY ALL), "
    "m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY chrom, pos, pop)) AS w FROM l), post AS (SELECT *, w / sum(w) OVER (PARTITION BY chrom, pos, pop) AS p FROM m)"
)


@query(
    f"{_POST}, a1 AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY chrom, pos, pop ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + p / 2 AS c FROM post) "
    "SELECT a.chrom, a.pos, a.pop AS pop1, b.pop AS pop2, round(sum(a.c * b.p), 6) AS p_less FROM a1 a JOIN post b ON a.chrom = b.chrom AND a.pos = b.pos AND a.i = b.i AND a.pop < b.pop GROUP BY ALL"
)
def allele_freq_compare(s, d):
    return models.allele_freq_compare(models.frequency_posterior(views.genotypes(s, d)))


def _inbreeding(steps: int) -> str:
    text = f"WITH {sql.NORMAL}, fs AS (SELECT CAST(x AS DOUBLE) AS f FROM (VALUES (0.0), (0.1), (0.2), (0.3), (0.5)) v(x)), q0 AS (SELECT DISTINCT chrom, pos, f, CAST(0.5 AS DOUBLE) AS p FROM normal, fs)"
    w = "l0 * ((1 - p) * (1 - p) + f * p * (1 - p))", "l1 * 2 * p * (1 - p) * (1 - f)", "l2 * (p * p + f * p * (1 - p))"
    for t in range(steps):
        text += f", q{t + 1} AS (SELECT chrom, pos, f, sum(({w[1]} + 2 * {w[2]}) / ({' + '.join(w)})) / (2 * count(*)) AS p FROM normal JOIN q{t} USING (chrom, pos) GROUP BY ALL)"
    return text + f" SELECT f, round(sum(ln({' + '.join(w)})), 3) AS ll FROM normal JOIN q{steps} USING (chrom, pos) GROUP BY f"


@query(_inbreeding(3))
def inbreeding(s, d):
    return models.inbreeding_surface(views.genotypes(s, d))


@query(
    f"WITH {sql.NORMAL}, d AS (SELECT chrom, pos, round(l1 + 2 * l2, 6) AS d, (sample * 7) % 5 AS y FROM normal), "
    "r AS (SELECT *, rank() OVER (PARTITION BY chrom, pos ORDER BY d) + (count(*) OVER (PARTITION BY chrom, pos, d) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY chrom, pos ORDER BY y) + (count(*) OVER (PARTITION BY chrom, pos, y) - 1) / 2.0 AS ry FROM d) "
    "SELECT chrom, pos, count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM r GROUP BY ALL HAVING count(*) >= 3 AND min(rx) < max(rx) AND min(ry) < max(ry)"
)
def spearman_gwas(s, d):
    traits = views.load(s, d, "lineitem").select(F.expr("l_suppkey % 12").alias("sample")).distinct().withColumn("trait", F.expr("sample * 7 % 5"))
    return models.spearman(views.genotypes(s, d), traits)


def _traits(s, d):
    return views.load(s, d, "lineitem").select(F.expr("l_suppkey % 12").alias("sample")).distinct().withColumn("trait", F.expr("sample * 7 % 5"))


@query(
    f"WITH {sql.NORMAL}, d AS (SELECT chrom, pos, pop, round(l1 + 2 * l2, 6) AS d, (sample * 7) % 5 AS y FROM normal), "
    "r AS (SELECT *, rank() OVER (PARTITION BY chrom, pos, pop ORDER BY d) + (count(*) OVER (PARTITION BY chrom, pos, pop, d) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY chrom, pos, pop ORDER BY y) + (count(*) OVER (PARTITION BY chrom, pos, pop, y) - 1) / 2.0 AS ry FROM d), "
    "cor AS (SELECT chrom, pos, pop, count(*) AS n, corr(rx, ry) AS r FROM r GROUP BY ALL HAVING count(*) > 1 AND min(rx) < max(rx) AND min(ry) < max(ry)), "
    "sums AS (SELECT chrom, pos, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_pops, sum((n - 1) * r * r) AS e, sum((n - 1) * (1 - r * r)) AS l FROM cor GROUP BY ALL) "
    "SELECT chrom, pos, n, n_pops, CASE WHEN l > 1e-12 THEN round(e / l * (n - n_pops) / n_pops, 4) END AS f FROM sums WHERE n > n_pops"
)
def spearman_pooled(s, d):
    """f at four places, halves up; what its few roundings can take from a half is added before."""
    rows = models.spearman_pooled(views.genotypes(s, d), _traits(s, d))
    return rows.select("chrom", "pos", "n", "n_pops", F.when(F.col("f") < float("inf"), F.round(F.col("f") * (1 + 1e-12), 4)).alias("f"))


@query()
def spearman_permuted(s, d):
    """With p from the F distribution, and from 99 permutations where that is below 0.05."""
    return models.spearman_pooled(views.genotypes(s, d), _traits(s, d), 99)


_DIST = (
    f"WITH {sql.GL}, k AS (SELECT chrom, pos, pop, count(*) AS n, CAST(2 * count(*) - sum(gt) AS BIGINT) AS n_a, count_if(gt = 1) AS n_ab FROM gl GROUP BY ALL), cases AS (SELECT DISTINCT n, n_a, 2 * n - n_a AS b FROM k), "
    "h AS (SELECT *, unnest(range(0, least(n_a, b) + 1)) AS h FROM cases), "
    "p AS (SELECT n, n_a, h, exp(h * ln(2.0) + lgamma(n + 1) + lgamma(n_a + 1) + lgamma(b + 1) - lgamma(2 * n + 1) - lgamma((n_a - h) // 2 + 1) - lgamma(h + 1) - lgamma((b - h) // 2 + 1)) AS p FROM h WHERE (h - n_a) % 2 = 0), "
    "d AS (SELECT chrom, pos, pop, h, p FROM k JOIN p USING (n, n_a)), l AS (SELECT chrom, pos, count(*) AS n_pops, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_ab) AS BIGINT) AS n_ab FROM k GROUP BY ALL), "
    + ", ".join(f"d{k} AS (SELECT l.chrom, l.pos, coalesce(h, 0) AS h, coalesce(p, 1.0) AS p FROM l LEFT JOIN (SELECT * FROM d WHERE pop = {k}) x ON x.chrom = l.chrom AND x.pos = l.pos)" for k in range(3))
)


@query(
    f"{_DIST}, s AS (SELECT l.*, d0.h + d1.h + d2.h AS h, d0.p * d1.p * d2.p AS p FROM l JOIN d0 USING (chrom, pos) JOIN d1 USING (chrom, pos) JOIN d2 USING (chrom, pos)) "
    "SELECT chrom, pos, n_pops, n, n_ab, round(sum(CASE WHEN h <= n_ab THEN p ELSE 0 END), 6) AS p_less, round(sum(CASE WHEN h >= n_ab THEN p ELSE 0 END), 6) AS p_more FROM s GROUP BY ALL"
)
def hwe_populations(s, d):
    return population.hwe_populations(population.pop_genotype_counts(views.genotypes(s, d)))


@query(f"WITH {sql.GL} SELECT sample, chrom, pos // 1000 AS block, string_agg(CAST(gt AS VARCHAR), ' ' ORDER BY pos) AS line FROM gl GROUP BY ALL")
def to_lfmm(s, d):
    return models.to_lfmm(views.genotypes(s, d), 1000)


@query(f"WITH {sql.GL} SELECT sample, chrom, pos, {', '.join(f'CAST(gt = {k} AS INT) AS has{k}' for k in range(3))} FROM gl")
def to_sambada(s, d):
    return models.to_sambada(views.genotypes(s, d))


#: Samples 3, 7 and 11 are haploid in the calls that are written: a copy of the alternative or none.
_CELLS = "t AS (SELECT *, CASE WHEN sample % 4 = 3 THEN 1 ELSE 2 END AS ploidy, CASE WHEN sample % 4 = 3 THEN gt // 2 ELSE gt END AS g FROM gl)"


def mixed(s, d):
    rows = views.with_alleles(views.genotypes(s, d)).withColumn("ploidy", F.when(F.col("sample") % 4 == 3, 1).otherwise(2))
    return rows.withColumn("gt", F.when(F.col("ploidy") == 1, F.expr("CAST(gt div 2 AS INT)")).otherwise(F.col("gt")))


@query(
    f"WITH {sql.GL}, {_CELLS}, u AS (SELECT *, CASE ploidy WHEN 1 THEN CAST(g AS VARCHAR) ELSE ['0/0', '0/1', '1/1'][g + 1] END || ':' || CASE ploidy WHEN 1 THEN pl0 || ',' || pl2 ELSE pl0 || ',' || pl1 || ',' || pl2 END || ':' || dp AS v FROM t) "
    f"SELECT chrom, pos, concat_ws(chr(9), chrom, pos, '.', {sql.LOCUS_REF}, {sql.LOCUS_ALT}, '.', 'PASS', 'NS=' || count(*) || ';DP=' || CAST(sum(dp) AS BIGINT), 'GT:PL:DP', "
    + ", ".join(f"coalesce(max(v) FILTER (sample = {k}), './.')" for k in range(12))
    + ") AS line FROM u GROUP BY chrom, pos"
)
def write_vcf(s, d):
    return models.to_vcf(mixed(s, d), 12, ("GT", "PL", "DP"), ("NS", "DP"))
