"""Queries of estimates that refine themselves, and of what becomes of mates."""

from pyspark.sql import functions as F

from helixmill.operators import estimates, loci, mates
from helixmill.plans import sql
from helixmill.plans.loci import PER_SAMPLE, _by_sample
from helixmill.plans.registry import query
from helixmill.sources import views

_FLAGS = {"paired": "name % 9 <> 0", "proper": "(name + is_second) % 13 <> 0", "passed": "(name * 7 + is_second * 3) % 11 <> 0"}
_MOVED = "pos + CASE WHEN name % 19 = 0 AND is_second = 1 THEN 3000 ELSE 0 END"
_MODES = {"none": None, "mask": False, "regions": True}
_POROSITY = 0.2


def _states(mode: str) -> str:
    goes = {"none": "{u} < 0", "mask": "{h} AND {u} >= 0.2", "regions": "NOT {h} AND {u} >= 0.2"}[mode]
    single = goes.format(h="hit", u=sql.draw("read_id"))
    pair = goes.format(h="(a_hit OR b_hit)", u=sql.draw("name"))
    both = f"CASE WHEN a_rg <> b_rg THEN 'mismatch' WHEN {pair} THEN 'masked' ELSE 'pair' END"
    met = "n = 2 AND a_passed AND a_proper AND b_passed AND b_pos - a_pos <= 2000"
    poison = "k = 2 AND ((a_passed AND NOT a_proper) OR (NOT a_passed AND a_proper))"
    return (
        f"SELECT '{mode}' AS mode, read_id, CASE WHEN NOT passed THEN 'filtered' WHEN NOT paired THEN CASE WHEN {single} THEN 'masked' ELSE 'single' END WHEN n > 2 THEN 'repeated' "
        f"WHEN {poison} THEN 'poisoned' WHEN {met} THEN {both} ELSE 'orphan' END AS status FROM w"
    )


_ENDS = ", ".join(f"{f}_value({c}) OVER w AS {k}_{c}" for k, f in (("a", "first"), ("b", "last")) for c in ("passed", "proper", "pos", "rg", "hit"))


@query(
    f"WITH {sql.PAIRS}, {sql.REGIONS}, {sql.MERGED}, base AS (SELECT name * 3 + is_second AS read_id, name, rg, chrom, {_MOVED} AS pos, len, {', '.join(f'{v} AS {c}' for c, v in _FLAGS.items())} FROM mates), "
    "r AS (SELECT * FROM base UNION ALL SELECT read_id + 1, name, rg, chrom, pos + 5, len, paired, proper, passed FROM base WHERE name % 17 = 0 AND read_id % 3 = 1), "
    "h AS (SELECT *, EXISTS (SELECT 1 FROM merged g WHERE g.chrom = r.chrom AND r.pos < g.stop AND r.pos + r.len > g.start) AS hit FROM r), "
    f"w AS (SELECT *, count(*) OVER w AS n, {_ENDS}, row_number() OVER (PARTITION BY chrom, name, paired ORDER BY pos, read_id, len, rg, proper, passed) AS k FROM h WINDOW w AS (PARTITION BY chrom, name, paired ORDER BY pos, read_id, len, rg, proper, passed ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) "
    + " UNION ALL ".join(map(_states, _MODES))
)
def mate_states(s, d):
    """Reads with filtered, improper, far, repeated and unpaired ones among them: without regions, outside them, and inside."""
    rows = views.pairs_source(s, d).selectExpr("name * 3 + is_second AS read_id", "name", "rg", "chrom", f"{_MOVED} AS pos", "len", *(f"{v} AS {c}" for c, v in _FLAGS.items()))
    again = rows.where("name % 17 = 0 AND read_id % 3 = 1").withColumns({"read_id": F.col("read_id") + 1, "pos": F.col("pos") + 5})
    rows, out = rows.unionByName(again), None
    for mode, inside in _MODES.items():
        got = mates.mate_states(rows, None if mode == "none" else views.regions(s, d), bool(inside), 0.0 if mode == "none" else _POROSITY).withColumn("mode", F.lit(mode))
        out = got if out is None else out.unionByName(got)
    return out


def _log_density(grid: str) -> str:
    """Rounded log posterior of each locus and population at the frequencies f of a table."""
    return f"SELECT chrom, pos, pop, i, round(any_value(-0.3 * ln(f) - 0.3 * ln(1 - f)) + sum(ln(l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)), 9) AS l FROM normal {grid} GROUP BY ALL"


@query(
    f"WITH {sql.NORMAL}, g0 AS (SELECT range AS i, least(greatest(CAST(range AS DOUBLE) / 100, 1e-16::DOUBLE), 1 - 1e-16::DOUBLE) AS f FROM range(0, 101)), l0 AS ({_log_density(', g0')}), "
    "t AS (SELECT *, max(l) OVER (PARTITION BY chrom, pos, pop) AS top FROM l0), "
    "ends AS (SELECT chrom, pos, pop, CAST(greatest(min(i) - 1, 0) AS DOUBLE) / 100 AS lo, CAST(least(max(i) + 1, 100) AS DOUBLE) / 100 AS hi FROM t WHERE l >= top - 14 GROUP BY ALL), "
    "g1 AS (SELECT chrom, pos, pop, range AS i, least(greatest(lo + range * ((hi - lo) / 1000), 1e-16::DOUBLE), 1 - 1e-16::DOUBLE) AS f FROM ends, range(0, 1001)), "
    f"l1 AS ({_log_density('JOIN g1 USING (chrom, pos, pop)')}), "
    "e AS (SELECT *, exp(l - max(l) OVER p) AS d, first_value(i) OVER (PARTITION BY chrom, pos, pop ORDER BY l DESC, i) AS best FROM l1 WINDOW p AS (PARTITION BY chrom, pos, pop)), "
    "cells AS (SELECT *, CASE WHEN i > best THEN 1 ELSE 0 END AS side, abs(i - best) AS dist, (d + CASE WHEN i > best THEN lag(d) OVER o ELSE lead(d) OVER o END) / 2 AS mass, "
    "sum(d) OVER p - (first_value(d) OVER o + last_value(d) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / 2 AS whole FROM e WINDOW p AS (PARTITION BY chrom, pos, pop), o AS (PARTITION BY chrom, pos, pop ORDER BY i)), "
    "k AS (SELECT *, min(d) OVER (PARTITION BY chrom, pos, pop, side ORDER BY dist) AS key FROM cells WHERE i <> best), "
    "m AS (SELECT *, coalesce(sum(mass) OVER (PARTITION BY chrom, pos, pop ORDER BY key DESC, side, dist ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k), "
    "s AS (SELECT chrom, pos, pop, any_value(best) AS best, coalesce(sum(least(1, (0.9::DOUBLE * whole - before) / mass)) FILTER (side = 0), 0) AS x, coalesce(sum(least(1, (0.9::DOUBLE * whole - before) / mass)) FILTER (side = 1), 0) AS y FROM m WHERE before < 0.9::DOUBLE * whole GROUP BY ALL) "
    "SELECT chrom, pos, pop, round(lo + best * ((hi - lo) / 1000), 6) AS map, round(lo + (best - x) * ((hi - lo) / 1000), 6) AS low, round(lo + (best + y) * ((hi - lo) / 1000), 6) AS high FROM s JOIN ends USING (chrom, pos, pop)"
)
def allele_freq_credible(s, d):
    """Credible intervals of allele frequencies on a second, finer grid."""
    return estimates.credible_intervals(views.genotypes(s, d))


_AT = {p: i + 1 for i, p in enumerate(sql.GENOTYPES)}
_HALF = [f"sum(ln(CASE WHEN one THEN (gl[{_AT[a, a]}] + gl[{_AT[b, b]}]) / 2 ELSE gl[{_AT[a, a]}] / 4 + gl[{_AT[a, b]}] / 2 + gl[{_AT[b, b]}] / 4 END))" for a, b in loci.PAIRS]
_PICK = lambda of: f"[{', '.join(str(of(a, b)) for a, b in loci.PAIRS)}][allele_pair + 1]"
_MAF = "least((nd * (d1 + 2 * d2) + nh * h1) / (nh + 2 * nd), 1 - (nd * (d1 + 2 * d2) + nh * h1) / (nh + 2 * nd))"
_TWO = "(l0 * d0 + l1 * d1 + l2 * d2)"


def _pair_frequencies(steps: int, min_maf: float, least: str) -> str:
    text = f"WITH RECURSIVE {PER_SAMPLE}, x AS MATERIALIZED (SELECT chrom, site, rg = 'R' AS one, gl FROM sites), q AS (SELECT chrom, site, list_transform([{', '.join(_HALF)}], lambda v: round(v, 9)) AS l FROM x GROUP BY ALL), "
    text += f"k AS (SELECT chrom, site, CAST(list_position(l, list_max(l)) - 1 AS INT) AS allele_pair FROM q), y AS MATERIALIZED (SELECT chrom, site, one, allele_pair, gl[{_PICK(lambda a, b: _AT[a, a])}] AS l0, gl[{_PICK(lambda a, b: _AT[a, b])}] AS l1, gl[{_PICK(lambda a, b: _AT[b, b])}] AS l2 FROM x JOIN k USING (chrom, site)), "
    text += "b AS (SELECT *, CASE WHEN round(l0, 9) >= greatest(round(l1, 9), round(l2, 9)) THEN 0 WHEN round(l1, 9) >= round(l2, 9) THEN 1 ELSE 2 END AS best FROM y), "
    text += "c AS (SELECT chrom, site, CAST(count_if(one) AS DOUBLE) AS nh, CAST(count_if(NOT one) AS DOUBLE) AS nd, count_if(one AND round(l2, 9) > round(l0, 9)) AS c1, count_if(NOT one AND best = 0) AS e0, count_if(NOT one AND best = 1) AS e1, count_if(NOT one AND best = 2) AS e2 FROM b GROUP BY ALL), "
    floor = lambda n, of: f"greatest(CASE WHEN {of} > 0 THEN ({n}) / {of} ELSE 0 END, 1e-6::DOUBLE)"
    text += f"f AS (SELECT chrom, site, nh, nd, {floor('nh - c1', 'nh')} AS x0, {floor('c1', 'nh')} AS x1, " + ", ".join(f"{floor(f'e{i}', 'nd')} AS y{i}" for i in range(3)) + " FROM c), "
    text += "s AS (SELECT chrom, site, nh, nd, x1 / (x0 + x1) AS h1, " + ", ".join(f"y{i} / (y0 + y1 + y2) AS d{i}" for i in range(3)) + " FROM f), "
    names = ("h1", "d0", "d1", "d2")
    new = {"h1": ("nh", "CASE WHEN one THEN l2 * h1 / (l0 * (1 - h1) + l2 * h1) ELSE 0 END"), **{f"d{i}": ("nd", f"CASE WHEN one THEN 0 ELSE l{i} * d{i} / {_TWO} END") for i in range(3)}}
    sums = ", ".join(f"CASE WHEN {n} > 0 THEN sum({v}) / {n} ELSE {k} END AS n_{k}" for k, (n, v) in new.items())
    change = "greatest(" + ", ".join(f"abs(n_{k} - {k})" for k in names) + ")"
    maf = _MAF.replace("d1", "n_d1").replace("d2", "n_d2").replace("h1", "n_h1")
    text += f"r AS (SELECT chrom, site, nh, nd, h1, d0, d1, d2, 0 AS steps, CASE WHEN {_MAF} < {min_maf} / 2 THEN 'rare' ELSE 'moving' END AS state FROM s UNION ALL "
    text += f"SELECT chrom, site, nh, nd, n_h1, n_d0, n_d1, n_d2, steps + 1, CASE WHEN {maf} < {min_maf} - {change} THEN 'rare' WHEN {change} < {least}::DOUBLE THEN 'still' ELSE 'moving' END FROM "
    text += f"(SELECT chrom, site, nh, nd, h1, d0, d1, d2, steps, {sums} FROM r JOIN y USING (chrom, site) WHERE state = 'moving' AND steps < {steps} GROUP BY chrom, site, nh, nd, h1, d0, d1, d2, steps)), "
    text += "z AS (SELECT chrom, site, arg_max({'nh': nh, 'nd': nd, 'h1': h1, 'd0': d0, 'd1': d1, 'd2': d2, 'steps': steps, 'state': state}, steps) AS e FROM r GROUP BY ALL), "
    text += "u AS (SELECT chrom, site, e.nh AS nh, e.nd AS nd, e.h1 AS h1, e.d0 AS d0, e.d1 AS d1, e.d2 AS d2, e.steps AS steps, e.state AS state FROM z), "
    kept = ", ".join(f"any_value({c}) AS {c}" for c in ("nh", "nd", *names, "steps", "state"))
    text += f"o AS (SELECT chrom, site, any_value(allele_pair) AS allele_pair, any_value(nh + nd) AS n, {kept}, sum(log10(CASE WHEN one THEN l0 * (1 - u.h1) + l2 * u.h1 ELSE l0 * u.d0 + l1 * u.d1 + l2 * u.d2 END)) AS ll FROM u JOIN y USING (chrom, site) GROUP BY chrom, site), "
    text += "v AS (SELECT *, round((nd * (d1 + 2 * d2) + nh * h1) / (nh + 2 * nd), 9) >= 0.5 AS swap FROM o) "
    a, b = _PICK(lambda a, b: a), _PICK(lambda a, b: b)
    return text + f"SELECT chrom, site, CAST(n AS BIGINT) AS n_samples, allele_pair, CAST(CASE WHEN swap THEN {b} ELSE {a} END AS INT) AS major, CAST(CASE WHEN swap THEN {a} ELSE {b} END AS INT) AS minor, round({_MAF}, 6) AS maf, round(ll, 6) + 0.0 AS ll, steps, state FROM v"


@query(_pair_frequencies(40, 0.05, "1e-4"))
def major_minor_frequency(s, d):
    """Allele pairs with their frequencies over read groups, of which R is taken for haploid; rare ones stop early."""
    rows = _by_sample(s, d).withColumn("ploidy", F.expr("CASE WHEN rg = 'R' THEN 1 ELSE 2 END"))
    return estimates.pair_frequencies(rows, "rg", 0.05, 1e-4, 40)


def _inbred(steps: int, f: float) -> str:
    w = [f"l0 * (1 - {f}) * (1 - p) * (1 - p)", f"l1 * (1 - {f}) * 2 * p * (1 - p)", f"l2 * (1 - {f}) * p * p", f"l0 * {f} * (1 - p)", f"l2 * {f} * p"]
    total = " + ".join(w)
    text = f"WITH {sql.NORMAL}, q0 AS (SELECT DISTINCT chrom, pos, CAST(0.5 AS DOUBLE) AS p FROM normal)"
    for t in range(1, steps + 1):
        text += f", q{t} AS (SELECT chrom, pos, sum(({w[1]} + 2 * {w[2]} + {w[4]}) / ({total})) / sum((2 * ({w[0]} + {w[1]} + {w[2]}) + {w[3]} + {w[4]}) / ({total})) AS p FROM normal JOIN q{t - 1} USING (chrom, pos) GROUP BY ALL)"
    text += f", o AS (SELECT chrom, pos, count(*) AS n, any_value(p) AS p, sum(ln({total})) AS ll, greatest(sum(ln(l0)), sum(ln(l2))) AS one FROM normal JOIN q{steps} USING (chrom, pos) GROUP BY ALL)"
    return text + " SELECT chrom, pos, n, round(p, 6) AS p, round(ll, 6) AS ll, round(one, 6) >= round(ll - 0.001, 6) AS monomorphic FROM o"


@query(_inbred(4, 0.1))
def inbreeding_loci(s, d):
    return estimates.inbreeding_loci(views.genotypes(s, d), 0.1, 4)


@query()
def inbreeding_fit(s, d):
    """The likeliest inbreeding coefficient, by rounds of one aggregate each."""
    got = estimates.inbreeding_fit(views.genotypes(s, d), steps=10)
    return got.select(F.round("f", 4).alias("f"), F.round("ll", 3).alias("ll"), F.round("ratio", 3).alias("ratio"), "rounds", F.round("monomorphic", 6).alias("monomorphic"))
