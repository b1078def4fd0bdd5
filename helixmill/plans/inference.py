"""Queries of allele pairs, counts, distances, ratios and the error model, with their SQL."""

from __future__ import annotations

from math import comb, log

from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import inference, loci, models, population, reads, selection, sites
from helixmill.plans import sql
from helixmill.plans.loci import PER_SAMPLE, _by_sample
from helixmill.plans.registry import ORACLES, query
from helixmill.sources import views

_HKY = (0.5, 0.001, 0.01)
_TABLE = models.substitution_table(*_HKY).tolist()
_INDEX = {g: i + 1 for i, g in enumerate(GENOTYPES)}


def _pick(name: str, x: int, y: int) -> str:
    return f"{name}[{_INDEX[min(x, y), max(x, y)]}]"


# samples and loci


@query(f"WITH {sql.GL} SELECT a.chrom, a.pos, a.sample AS s1, b.sample AS s2, a.gt AS g1, b.gt AS g2 FROM gl a JOIN gl b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample < b.sample")
def sample_pairs(s, d):
    return population.sample_pairs(views.genotypes(s, d))


@query(
    f"WITH {sql.GL}, x AS (SELECT DISTINCT sample, pop FROM gl), f AS (SELECT a.sample AS s1, b.sample AS s2, round(avg(CAST(a.gt <> b.gt AS DOUBLE)), 6) AS f2 FROM gl a JOIN gl b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample < b.sample GROUP BY ALL) "
    "SELECT least(a.pop, b.pop) AS pop1, greatest(a.pop, b.pop) AS pop2, count(*) AS n_pairs, round(avg(coalesce(f.f2, 0)), 6) AS f2 FROM x a JOIN x b ON a.sample < b.sample LEFT JOIN f ON f.s1 = a.sample AND f.s2 = b.sample GROUP BY ALL"
)
def f2_populations(s, d):
    return population.f2_populations(views.genotypes(s, d))


_THIN = f"""RECURSIVE {sql.GL}, good AS (SELECT DISTINCT chrom, pos FROM gl WHERE dp >= 2), nx AS (SELECT chrom, pos, min(pos) OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 50 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM good),
thin AS (SELECT chrom, min(pos) AS pos FROM good GROUP BY chrom UNION ALL SELECT nx.chrom, nx.nxt FROM thin JOIN nx ON thin.chrom = nx.chrom AND thin.pos = nx.pos WHERE nx.nxt IS NOT NULL)"""


@query(f"WITH {_THIN} SELECT chrom, pos FROM thin")
def thin_loci(s, d):
    return population.thin_loci(views.genotypes(s, d).where("dp >= 2"), 50)


@query(
    f"WITH {_THIN}, r AS (SELECT chrom, pos, sample, row_number() OVER (PARTITION BY chrom, pos ORDER BY dp DESC, sample) AS k FROM gl SEMI JOIN thin USING (chrom, pos) WHERE dp >= 2), "
    "t AS (SELECT gl.chrom, gl.pos, gl.sample, CASE WHEN r.k <= 3 THEN ['0/0', '0/1', '1/1'][gl.gt + 1] ELSE 'NA' END AS v FROM gl LEFT JOIN r ON gl.chrom = r.chrom AND gl.pos = r.pos AND gl.sample = r.sample) SELECT chrom, pos, concat_ws(' ', "
    + ", ".join(f"coalesce(max(v) FILTER (sample = {k}), 'NA')" for k in range(12))
    + ") AS line FROM t GROUP BY chrom, pos"
)
def to_genfile(s, d):
    return population.to_genfile(views.genotypes(s, d), 12, 50, 3, 2)


@query(f"WITH {sql.READS} SELECT 'i' || k AS info, chrom, pos + k % 80 - clip_left AS site FROM reads WHERE k % 80 >= clip_left AND k % 80 < clip_left + len")
def liftover_project(s, d):
    named = views.reads(s, d).withColumn("name", F.concat(F.lit("src_"), F.expr("k % 80"), F.lit("_i"), F.col("k")))
    return loci.lifted(named)


_REF = "((pos + off) * (pos + off + 7 * chrom) % 97 % 4)"


@query(
    f"WITH {sql.PAIRS}, m AS (SELECT chrom, name AS k, 0 AS is_second, pos1 AS pos, len1 AS len, len1 AS ahead FROM pairs WHERE status = 'pair' UNION ALL SELECT chrom, name, 1, pos2, len2, len1 FROM pairs WHERE status = 'pair'), "
    f"b0 AS (SELECT *, unnest(range(0, len)) AS off FROM m), b1 AS (SELECT *, {_REF} AS ref FROM b0), b AS (SELECT *, CASE WHEN (k * 31 + off * 17 + chrom) % 29 = 0 THEN (ref + 1 + (k + off) % 3) % 4 ELSE ref END AS base, CASE WHEN is_second = 1 THEN len - 1 - off ELSE off END AS c FROM b1), "
    "e AS (SELECT is_second + 1 AS mate, is_second AS is_rev, c AS cycle, ref, base FROM b UNION ALL SELECT 0, is_second, c + CASE WHEN is_second = 1 THEN ahead ELSE 0 END, ref, base FROM b), g AS (SELECT mate, is_rev, cycle, ref, base, count(*) AS n FROM e GROUP BY ALL) "
    "SELECT *, round(n / sum(n) OVER (PARTITION BY mate, is_rev, cycle, ref), 4) AS share FROM g"
)
def cycle_transition_table(s, d):
    pairs = reads.pair_mates(views.pairs_source(s, d)).where("status = 'pair'")
    mate = lambda k: F.struct(F.lit(k - 1).alias("is_second"), F.col(f"pos{k}").alias("pos"), F.col(f"len{k}").alias("len"), F.col("len1").alias("ahead"))
    rows = views.explode_bases(pairs.select("chrom", F.col("name").alias("k"), F.inline(F.array(mate(1), mate(2)))).withColumn("is_rev", F.col("is_second")))
    rows = rows.withColumn("base", F.expr("CASE WHEN (k * 31 + off * 17 + chrom) % 29 = 0 THEN (ref + 1 + (k + off) % 3) % 4 ELSE ref END"))
    return loci.cycle_transitions(rows)


# allele pairs and counts


def _mle(steps: int) -> str:
    text = f"WITH {PER_SAMPLE}, each AS (" + " UNION ALL ".join(f"SELECT chrom, site, ref, rg, gl, {k} AS k, {a} AS a, {b} AS b, {_pick('gl', a, a)} AS l0, {_pick('gl', a, b)} AS l1, {_pick('gl', b, b)} AS l2 FROM sites" for k, (a, b) in enumerate(inference.PAIRS)) + ")"
    text += f", f0 AS (SELECT DISTINCT chrom, site, k, {', '.join(f'1.0::DOUBLE / 3 AS p{k}' for k in range(3))} FROM each)"
    total = "(l0 * p0 + l1 * p1 + l2 * p2)"
    for t in range(1, steps + 1):
        text += f", f{t} AS (SELECT chrom, site, k, {', '.join(f'sum(l{k} * p{k} / {total}) / count(*) AS p{k}' for k in range(3))} FROM each JOIN f{t - 1} USING (chrom, site, k) GROUP BY ALL)"
    text += f", l AS (SELECT chrom, site, k, any_value(a) AS a, any_value(b) AS b, count(*) AS n_samples, any_value(p1) / 2 + any_value(p2) AS f, sum(log10({total})) AS ll, " + ", ".join(f"sum(log10({_pick('gl', b, b)})) AS x{b}" for b in range(4)) + f" FROM each JOIN f{steps} USING (chrom, site, k) GROUP BY ALL)"
    text += ", o AS (SELECT *, row_number() OVER (PARTITION BY chrom, site ORDER BY round(ll, 9) DESC, k) AS r FROM l), m AS (SELECT *, CASE WHEN round(f, 9) < 0.5 THEN a ELSE b END AS major, CASE WHEN round(f, 9) < 0.5 THEN b ELSE a END AS minor FROM o WHERE r = 1)"
    return text + " SELECT chrom, site, n_samples, CAST(major AS BIGINT) AS major, CAST(minor AS BIGINT) AS minor, round(least(f, 1 - f), 6) AS maf, CAST(round(greatest(0, 10 * (ll - [x0, x1, x2, x3][major + 1]))) AS BIGINT) AS quality, round(ll, 6) + 0.0 AS ll FROM m"


@query(_mle(3))
def major_minor_mle(s, d):
    return inference.major_minor_mle(_by_sample(s, d), "rg", 3)


def _saf(n: int) -> str:
    """Three samples as columns; counts of one minor are sums over their genotypes."""
    text = f"WITH {PER_SAMPLE}, w AS (SELECT chrom, site, ref, count(*) AS n_samples, " + ", ".join(f"coalesce(max(gl) FILTER (rg = '{g}'), list_transform(range(0, 10), lambda x: 1.0::DOUBLE)) AS g{i}" for i, g in enumerate("ANR")) + " FROM sites GROUP BY ALL)"

    def total(a: int, j: int) -> str:
        out = []
        for b in range(4):
            if b != a:
                parts = []
                for x in range(3):
                    for y in range(3):
                        z = j - x - y
                        if 0 <= z <= 2:
                            parts.append(f"{2 ** ((x == 1) + (y == 1) + (z == 1))} * " + " * ".join(_pick(f"g{k}", *((a, a), (a, b), (b, b))[v]) for k, v in enumerate((x, y, z))))
                out.append(f"({' + '.join(parts)})")
        return f"ln(({' + '.join(out)}) / {comb(2 * n, j)}.0)"

    text += ", l AS (SELECT chrom, site, ref, n_samples, CASE ref " + " ".join(f"WHEN {a} THEN [{', '.join(total(a, j) for j in range(2 * n + 1))}]" for a in range(4)) + " END AS l FROM w)"
    text += f", r AS (SELECT chrom, site, ref, n_samples, list_transform(l, lambda x: round(x - list_max(l), 6)) AS l FROM l), k AS (SELECT *, list_filter(range(0, {2 * n + 1}), lambda j: l[j + 1] >= -20.72326583694641) AS good FROM r)"
    return text + " SELECT chrom, site, ref, n_samples, CAST(list_min(good) AS INT) AS lower, array_to_string(list_transform(l[list_min(good) + 1 : list_max(good) + 1], lambda x: CAST(x + 0.0 AS DECIMAL(14, 6))), ',') AS saf FROM k"


@query(_saf(3))
def saf(s, d):
    rows = inference.saf(_by_sample(s, d), "rg", 3)
    return rows.withColumn("saf", F.array_join(F.transform("saf", lambda x: (x + 0.0).cast("decimal(14,6)").cast("string")), ","))


_CONVOLVED = "list_reduce(list(list_value(l0, 2 * l1, l2) ORDER BY sample), lambda a, b: list_transform(range(0, len(a) + 2), lambda j: list_sum(list_transform(range(0, 3), lambda k: CASE WHEN j - k >= 0 AND j - k < len(a) THEN a[j - k + 1] * b[k + 1] ELSE 0 END))))"
_SAFS = (
    f"{sql.NORMAL}, h AS (SELECT chrom, pos, pop, 2 * count(*) AS n, {_CONVOLVED} AS h FROM normal GROUP BY ALL), "
    "l AS (SELECT chrom, pos, pop, n, list_transform(range(0, n + 1), lambda j: ln(h[j + 1]) + lgamma(j + 1) + lgamma(n - j + 1) - lgamma(n + 1)) AS l FROM h), safs AS (SELECT chrom, pos, pop, n, list_transform(l, lambda x: round(x - list_max(l), 6)) AS saf FROM l)"
)
ORACLES["saf_biallelic"] = f"WITH {_SAFS} SELECT chrom, pos, pop, array_to_string(list_transform(saf, lambda x: CAST(x + 0.0 AS DECIMAL(14, 6))), ',') AS saf FROM safs"
ORACLES["allele_counts_ml"] = f"WITH {_SAFS} SELECT chrom, pos, pop, CAST(list_position(saf, list_max(saf)) - 1 AS BIGINT) AS n_alt, CAST(n AS INT) AS n_total FROM safs"
ORACLES["to_beagle"] = (
    f"WITH {sql.NORMAL}, t AS (SELECT chrom, pos, sample, {' || chr(32) || '.join(f'CAST(CAST(round(l{k}, 4) AS DECIMAL(6, 4)) AS VARCHAR)' for k in range(3))} AS v FROM normal) SELECT chrom || '_' || pos AS marker, concat_ws(' ', "
    + ", ".join(f"coalesce(max(v) FILTER (sample = {k}), '0.3333 0.3333 0.3333')" for k in range(12))
    + ") AS line FROM t GROUP BY chrom, pos"
)


# distance and ratio


def _distance(steps: int) -> str:
    terms = inference.class_terms()
    post = lambda k: [f"g{k}[{i + 1}]" for i in range(10)]
    text = f"WITH {PER_SAMPLE}, j AS (SELECT a.rg AS s1, b.rg AS s2, a.gl AS g1, b.gl AS g2, list_sum(a.gl) AS t1, list_sum(b.gl) AS t2 FROM sites a JOIN sites b ON a.chrom = b.chrom AND a.site = b.site AND a.rg < b.rg), "
    pis = ", ".join("sum(" + " + ".join(f"{post(k)[i]} * {g.count(b)} / t{k}" for k in (1, 2) for i, g in enumerate(GENOTYPES) if b in g) + f") / (4 * count(*)) AS pi{b}" for b in range(4))
    phis = ", ".join("sum((" + " + ".join(f"{post(1)[i]} * {post(2)[j]}" for c, i, j, _ in terms if c == k) + f") / (t1 * t2)) / count(*) AS phi{k}" for k in range(9))
    text += f"e0 AS (SELECT s1, s2, count(*) AS n, {pis}, {phis} FROM j GROUP BY ALL)"
    weight = lambda bases: " * ".join(f"pi{b}" for b in bases)
    for t in range(steps):
        w = ", ".join(f"phi{k} * (" + " + ".join(f"{post(1)[i]} * {post(2)[j]} * {weight(b)}" for c, i, j, b in terms if c == k) + ") / (" + " + ".join(weight(b) for c, _, _, b in terms if c == k) + f") AS w{k}" for k in range(9))
        whole = " + ".join(f"w{k}" for k in range(9))
        text += f", h{t} AS (SELECT s1, s2, n, pi0, pi1, pi2, pi3, {w} FROM j JOIN e{t} USING (s1, s2)), e{t + 1} AS (SELECT s1, s2, n, pi0, pi1, pi2, pi3, {', '.join(f'sum(w{k} / ({whole})) / count(*) AS phi{k}' for k in range(9))} FROM h{t} GROUP BY ALL)"
    of = lambda weights: " + ".join(f"phi{k} * {x}" for k, x in enumerate(weights))
    return text + f" SELECT s1, s2, n, round({of(inference.SQUARED)}, 6) AS squared, round(sqrt({of(inference.SQUARED)}), 6) AS euclidean, round({of(inference.MISMATCH)}, 6) AS mismatch FROM e{steps}"


@query(_distance(2))
def genetic_distance(s, d):
    return inference.genetic_distance(_by_sample(s, d), "rg", 2)


_GRID = [-4 + 3.5 * i / 20 for i in range(21)]


def _prior(x: float, i: int) -> str:
    from math import exp

    a, b = GENOTYPES[i]
    e = exp(-(10**x))
    raw = f"f{a} * ({e!r} + f{a} * {1 - e!r})" if a == b else f"2 * f{a} * f{b} * {1 - e!r}"
    return raw


def _ratio() -> str:
    text = f"WITH {sql.LIKELIHOODS}, {sql.REGIONS}, r AS (SELECT chrom, site, 1 + max(k % 2) AS region FROM (SELECT chrom, unnest(range(start, stop)) AS site, CAST(start // 100 AS BIGINT) AS k FROM regions) GROUP BY ALL), x AS (SELECT region, gl, list_sum(gl) AS t FROM sites JOIN r USING (chrom, site)), "
    text += "f AS (SELECT region, " + ", ".join("avg((" + " + ".join(f"gl[{i + 1}] * {g.count(b)}" for i, g in enumerate(GENOTYPES) if b in g) + f") / (2 * t)) AS f{b}" for b in range(4)) + " FROM x GROUP BY region)"
    each = []
    for k, v in enumerate(_GRID):
        norm = " + ".join(_prior(v, i) for i in range(10))
        each.append(f"sum(ln(({' + '.join(f'gl[{i + 1}] * {_prior(v, i)}' for i in range(10))}) / ({norm}))) AS l{k}")
    text += f", s AS (SELECT region, {', '.join(each)} FROM x JOIN f USING (region) GROUP BY region), u AS (" + " UNION ALL ".join(f"SELECT region, {v * log(10)!r} AS x, l{k} AS l FROM s" for k, v in enumerate(_GRID)) + ")"
    text += ", p AS (SELECT a.x - b.x AS phi, a.l + b.l - (a.x - b.x) * (a.x - b.x) / 2 AS l FROM u a JOIN u b ON a.region = 1 AND b.region = 2), q AS (SELECT phi, exp(l - (SELECT max(l) FROM p)) AS w FROM p), m AS (SELECT sum(w) AS t, sum(w * phi) / sum(w) AS m FROM q)"
    return text + " SELECT round(any_value(m), 4) AS mean, round(sqrt(sum(w * (phi - m) * (phi - m)) / any_value(t)), 4) AS deviation, round(sum(CASE WHEN phi > 0 THEN w ELSE 0 END) / any_value(t), 4) AS p_above FROM q, m"


@query(_ratio())
def theta_ratio(s, d):
    """Regions that begin in an even hundred of places against the others."""
    rows = sites.genotype_likelihoods(views.bases(s, d))
    r = views.regions(s, d)
    odd = F.floor(F.col("start") / 100) % 2 == 1
    parts = [selection.sites_in_regions(rows, r.where(odd if k == 2 else ~odd)).withColumn("region", F.lit(k)) for k in (1, 2)]
    return inference.theta_ratio(parts[0].unionByName(parts[1]))


# error model

_EPS = "pow(10.0, -qual / 10)"
_MODELS = (
    f"{sql.BASES}, x AS (SELECT chrom, site, ref, base, qual, rg, is_rev, least(CASE WHEN is_rev = 1 THEN len - 1 - off ELSE off END, 20) AS d5 FROM bases), "
    f"m AS (SELECT *, CASE rg WHEN 'A' THEN 1 / (1 + exp(-(0.1 + 0.9 * ln({_EPS} / (1 - {_EPS}))))) WHEN 'N' THEN 1 / (1 + exp(-(-0.2 + 1.1 * ln({_EPS} / (1 - {_EPS}))))) ELSE {_EPS} END AS eps, CASE is_rev WHEN 1 THEN 0.1 ELSE 0.2 END * exp(-0.3 * d5) + 0.01 AS psi FROM x)"
)
_E = ", ".join(f"CASE WHEN base = {k} THEN 1 - eps ELSE eps / 3 END AS e{k}" for k in range(4))
_L = "e0 AS l0, CASE WHEN is_rev = 0 THEN (1 - psi) * e1 + psi * e3 ELSE e1 END AS l1, CASE WHEN is_rev = 1 THEN (1 - psi) * e2 + psi * e0 ELSE e2 END AS l2, e3 AS l3"
_PI = "CASE ref " + " ".join(f"WHEN {r} THEN [{', '.join(repr(x) for x in row)}]" for r, row in enumerate(_TABLE)) + " END"
_B = ", ".join("(" + " + ".join(f"p[{i + 1}]" if g == (b, b) else f"p[{i + 1}] * l{b} / (l{g[0]} + l{g[1]})" for i, g in enumerate(GENOTYPES) if b in g) + f") AS b{b}" for b in range(4))
_HELD = (
    f"{_MODELS}, n0 AS (SELECT *, {_E} FROM m), n1 AS (SELECT *, {_L} FROM n0), g0 AS (SELECT chrom, site, ref, [{', '.join(f'sum(ln((l{a} + l{b}) / 2))' for a, b in GENOTYPES)}] AS g FROM n1 GROUP BY ALL), "
    f"g1 AS (SELECT chrom, site, g, {_PI} AS pi FROM g0), g2 AS (SELECT chrom, site, [{', '.join(f'exp(g[{i + 1}] - list_max(g)) * pi[{i + 1}]' for i in range(10))}] AS w FROM g1), g3 AS (SELECT chrom, site, list_transform(w, lambda x: x / list_sum(w)) AS p FROM g2), held AS (SELECT n1.*, {_B} FROM n1 JOIN g3 USING (chrom, site))"
)
_AFTER = (
    "b0 * e0 / l0 + CASE WHEN is_rev = 1 THEN b2 * psi * e0 / l2 ELSE 0 END",
    "CASE WHEN is_rev = 0 THEN (1 - psi) ELSE 1 END * b1 * e1 / l1",
    "CASE WHEN is_rev = 1 THEN (1 - psi) ELSE 1 END * b2 * e2 / l2",
    "b3 * e3 / l3 + CASE WHEN is_rev = 0 THEN b1 * psi * e3 / l1 ELSE 0 END",
)


def _ended(s, d):
    rows = selection.end_distances(views.bases(s, d, "rg", "is_rev", "len"))
    return rows.withColumn("d5", F.least("d5", F.lit(20)))


def with_models(rows):
    s = rows.sparkSession
    errors = s.range(2).selectExpr("CASE id WHEN 0 THEN 'A' ELSE 'N' END AS rg", "CASE id WHEN 0 THEN 0.1D ELSE -0.2D END AS intercept", "CASE id WHEN 0 THEN 0.9D ELSE 1.1D END AS slope")
    damage = s.range(42).selectExpr("CAST(id DIV 21 AS INT) AS kind", "id % 21 AS dist", "CASE id DIV 21 WHEN 1 THEN 0.1D ELSE 0.2D END * exp(-0.3D * (id % 21)) + 0.01D AS psi")
    return inference.with_models(rows, errors, damage)


def _modelled(s, d):
    return with_models(_ended(s, d))


@query(f"WITH {_MODELS} SELECT rg, is_rev, d5, qual, round(eps, 9) AS eps, round(psi, 9) AS psi, count(*) AS n FROM m GROUP BY ALL")
def bases_x_models(s, d):
    return _modelled(s, d).groupBy("rg", "is_rev", "d5", "qual", F.round("eps", 9).alias("eps"), F.round("psi", 9).alias("psi")).agg(F.count("*").alias("n"))


def _held(s, d):
    return inference.expected(_modelled(s, d), _TABLE)[0]


@query(f"WITH {_HELD} SELECT is_rev AS kind, d5 AS dist, round(greatest(1e-9, sum(CASE WHEN is_rev = 0 THEN b1 * psi * e3 / l1 ELSE b2 * psi * e0 / l2 END) / sum(CASE WHEN is_rev = 0 THEN b1 ELSE b2 END)), 6) AS psi FROM held GROUP BY ALL")
def damage_mstep(s, d):
    return inference.damage_mstep(_held(s, d)).withColumn("psi", F.round("psi", 6))


@query(
    f"WITH {_HELD}, w AS ("
    + " UNION ALL ".join(f"SELECT CASE WHEN is_rev = 1 THEN {3 - k} ELSE {k} END AS was, CASE WHEN is_rev = 1 THEN 3 - base ELSE base END AS read, {_AFTER[k]} AS w FROM held WHERE base <> {k}" for k in range(4))
    + "), g AS (SELECT was, read, sum(w) AS w FROM w GROUP BY ALL) SELECT CAST(was AS BIGINT) AS was, read, round(w / sum(w) OVER (PARTITION BY was), 6) AS rho FROM g"
)
def rho_mstep(s, d):
    return inference.rho_mstep(_held(s, d)).withColumn("rho", F.round("rho", 6))


@query(
    f"WITH {_HELD}, c AS (SELECT qual, count(*) AS n, sum(1 - ({' + '.join(f'CASE WHEN base = {k} THEN {_AFTER[k]} ELSE 0 END' for k in range(4))})) AS w FROM held GROUP BY qual), "
    f"v AS (SELECT n, w, ln({_EPS} / (1 - {_EPS})) AS x, {_EPS} AS e FROM c), "
    "t AS (SELECT sum(w - n * e) AS f0, sum(x * (w - n * e)) AS f1, sum(n * e * (1 - e)) AS h0, sum(n * e * (1 - e) * x) AS h1, sum(n * e * (1 - e) * x * x) AS h2 FROM v) "
    "SELECT round((h2 * f0 - h1 * f1) / (h0 * h2 - h1 * h1), 5) AS intercept, round(1 + (h0 * f1 - h1 * f0) / (h0 * h2 - h1 * h1), 5) AS slope FROM t"
)
def epsilon_newton(s, d):
    """One whole step from the qualities as they are."""
    counts = [tuple(r) for r in inference.error_counts(_held(s, d)).collect()]  # a row for each quality
    a, b, _ = inference.epsilon_newton(counts, 0.0, 1.0, 1, 0)
    return s.createDataFrame([(round(a, 5), round(b, 5))], "intercept double, slope double")


@query()
def estimate_errors(s, d):
    return inference.estimate_errors(selection.end_distances(views.bases(s, d, "is_rev", "len")), *_HKY, iterations=3)


_FOUR = [f"miss + two{b}" for b in range(4)]


@query(f"WITH {sql.LIKELIHOODS}, h AS (SELECT chrom, site, ref, depth, [{', '.join(_FOUR)}] AS l FROM sums) SELECT chrom, site, ref, depth, {', '.join(f'round(exp(l[{b + 1}] - list_max(l)), 6) AS g{b}' for b in range(4))} FROM h")
def haploid_likelihoods(s, d):
    rows = sites.haploid_likelihoods(views.bases(s, d))
    return rows.select("chrom", "site", "ref", "depth", *(F.round(F.element_at("gl", b + 1), 6).alias(f"g{b}") for b in range(4)))
