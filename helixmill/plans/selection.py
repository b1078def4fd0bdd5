"""Queries of filters, joins, rewrites and simple calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import selection as sel
from helixmill.operators import intervals, sites
from helixmill.plans import sql
from helixmill.plans.registry import WIN, query
from helixmill.sources import views

INSIDE = "EXISTS (SELECT 1 FROM merged g WHERE g.chrom = p.chrom AND p.site >= g.start AND p.site < g.stop)"
CAPPED = "capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chrom, site ORDER BY read_id, qual, base) AS rn FROM bases) WHERE rn <= 3)"
TOP = "list_sort([{m: -na, b: 0}, {m: -nc, b: 1}, {m: -ng, b: 2}, {m: -nt, b: 3}])"
FOUR = ", ".join(f"count_if(base = {b}) AS n{'acgt'[b]}" for b in range(4))


def recal(qual: str, off: str) -> str:
    eps = f"pow(10.0, -{qual} / 10)"
    return f"CAST(greatest(1, floor(-10 * log10(1 / (1 + exp(-(0.1 + 0.9 * ln({eps} / (1 - {eps})) + 0.01 * {off})))) + 1e-9)) AS BIGINT)"


def _pile(s, d):
    return sites.pileup(views.bases(s, d))


def _chroms(s):
    return s.range(1, 4).withColumnRenamed("id", "chrom")


@query(f"WITH {sql.PILE}, {sql.REGIONS}, {sql.MERGED} SELECT chrom, site, depth FROM pile p WHERE {INSIDE}")
def site_regions(s, d):
    return sel.sites_in_regions(_pile(s, d), views.regions(s, d)).select("chrom", "site", "depth")


@query(f"WITH {sql.PILE}, {sql.REGIONS}, {sql.MERGED} SELECT chrom, site, depth FROM pile p WHERE NOT {INSIDE}")
def site_mask(s, d):
    return sel.sites_in_regions(_pile(s, d), views.regions(s, d), keep=False).select("chrom", "site", "depth")


@query(f"WITH {sql.READS}, {sql.REGIONS}, {sql.MERGED} SELECT read_id FROM reads r WHERE NOT EXISTS (SELECT 1 FROM merged g WHERE g.chrom = r.chrom AND r.pos < g.stop AND r.pos + r.len > g.start)")
def read_mask(s, d):
    return sel.read_mask(views.reads(s, d), views.regions(s, d)).select("read_id")


@query(f"WITH {sql.READS} SELECT read_id FROM reads WHERE name NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 = 0)")
def blacklist_anti(s, d):
    names = views.load(s, d, "orders").where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("name"))
    return sel.blacklist_anti(views.reads(s, d), names).select("read_id")


@query(f"WITH {sql.BASES}, w AS (SELECT *, lag(base) OVER (PARTITION BY uid ORDER BY off) AS prev FROM bases) SELECT chrom, site, count(*) AS n FROM w WHERE prev IS NULL OR prev * 4 + base NOT IN (6, 9) GROUP BY ALL")
def context_filter(s, d):
    return sel.context_filter(views.bases(s, d, "prev"), [(1, 2), (2, 1)]).groupBy("chrom", "site").agg(F.count("*").alias("n"))


@query(f"WITH {sql.PILE}, {sql.ALLELES} SELECT chrom, site, depth FROM pile SEMI JOIN alleles USING (chrom, site)")
def site_subset(s, d):
    return sel.known_sites(_pile(s, d), views.alleles(s, d)).select("chrom", "site", "depth")


@query(
    f"WITH {sql.PILE}, c AS (SELECT a.chrom, a.site FROM pile a JOIN pile b ON a.chrom = b.chrom AND b.site = a.site + 1 WHERE a.ref = 1 AND b.ref = 2), cg AS (SELECT * FROM c UNION ALL SELECT chrom, site + 1 FROM c) "
    "SELECT chrom, site, depth FROM pile ANTI JOIN cg USING (chrom, site)"
)
def site_cpg_filter(s, d):
    return sel.cpg_filter(_pile(s, d)).select("chrom", "site", "depth")


@query(f"WITH {sql.BASES} SELECT chrom, site, count(*) AS n FROM bases WHERE {sql.draw('(read_id * 70 + off)')} < 0.5 GROUP BY ALL")
def site_downsample(s, d):
    return sel.downsample_site_bases(views.bases(s, d), 0.5).groupBy("chrom", "site").agg(F.count("*").alias("n"))


@query(f"WITH {sql.PILE}, w AS (SELECT *, site // {WIN} AS win FROM pile), g AS (SELECT chrom, win FROM w GROUP BY ALL HAVING 1 - count(*) / {WIN}.0 <= 0.5) SELECT chrom, win, count(*) AS n FROM w SEMI JOIN g USING (chrom, win) GROUP BY ALL")
def window_filter(s, d):
    return sel.window_filter(_pile(s, d), WIN, 0.5).groupBy("chrom", "win").agg(F.count("*").alias("n"))


@query(f"WITH {sql.PILE}, f AS (SELECT CAST(v.c AS BIGINT) AS chrom, r.range AS site FROM (VALUES (1), (2), (3)) v(c), range(0, 50000) r) SELECT chrom, site, coalesce(depth, 0) AS depth FROM f LEFT JOIN pile USING (chrom, site)")
def full_grid_left(s, d):
    return sel.full_grid(_pile(s, d), _chroms(s), views.GENOME)


@query(f"WITH {sql.BASES} SELECT chrom, site, count(DISTINCT k % 4) AS n_samples, count(*) AS depth FROM bases GROUP BY ALL HAVING count(DISTINCT k % 4) >= 3")
def multi_sample_sites(s, d):
    return sel.multi_sample_sites(views.bases(s, d, "k").withColumn("sample", F.expr("k % 4")), 3)


@query(
    f"WITH {sql.REGIONS}, {sql.READS}, r AS (SELECT DISTINCT chrom, CAST(unnest(range(start, stop)) AS BIGINT) AS site FROM regions), m AS (SELECT DISTINCT chrom, CAST(unnest(range(pos, pos + 10)) AS BIGINT) AS site FROM reads WHERE k % 9 = 0), "
    "x AS (SELECT chrom, site, site - row_number() OVER (PARTITION BY chrom ORDER BY site) AS g FROM r ANTI JOIN m USING (chrom, site)) SELECT chrom, min(site) AS start, max(site) + 1 AS stop FROM x GROUP BY chrom, g"
)
def regions_except(s, d):
    mask = views.reads(s, d).where("k % 9 = 0").selectExpr("chrom", "pos AS start", "pos + 10 AS stop")
    return intervals.regions_except(views.regions(s, d), mask)


_UNITS = "SELECT 'm' || x || ':r' || y || ':f:' || (x + y) AS unit, 'pu' || (x * 2 + y) AS rg FROM (VALUES (0), (1)) a(x), (VALUES (0), (1)) b(y)"


@query(
    f"WITH {sql.READS}, n AS (SELECT rg, 'm' || (k % 3) || ':r' || (k % 2) || ':f:' || (k % 3 + k % 2) AS unit FROM reads), u AS ({_UNITS}) "
    "SELECT coalesce(u.rg, n.rg) AS rg, count(*) AS n FROM n LEFT JOIN u USING (unit) GROUP BY ALL"
)
def reassign_platform_unit(s, d):
    units = s.range(4).selectExpr("concat('m', id div 2, ':r', id % 2, ':f:', id div 2 + id % 2) AS unit", "concat('pu', id) AS rg")
    rows = views.reads(s, d).withColumn("full_name", F.expr("concat('m', k % 3, ':r', k % 2, ':f:', k % 3 + k % 2, ':', name)"))
    return sel.platform_groups(rows, units).groupBy("rg").agg(F.count("*").alias("n"))


@query(f"WITH {sql.READS} SELECT CASE WHEN rg IN ('A', 'R') THEN 'pool' ELSE rg END AS pool, count(*) AS n FROM reads GROUP BY ALL")
def rg_pool_map(s, d):
    pools = s.range(2).selectExpr("CASE id WHEN 0 THEN 'A' ELSE 'R' END AS rg", "'pool' AS pool")
    return sel.pooled_groups(views.reads(s, d), pools).groupBy("pool").agg(F.count("*").alias("n"))


@query(f"WITH {sql.READS} SELECT read_id, pos + 5 AS pos, len - 8 AS len, clip_left + 5 AS clip_left, clip_right + 3 AS clip_right FROM reads")
def clip_mapped_ends(s, d):
    return sel.clip_mapped_ends(views.reads(s, d), 5, 3).select("read_id", "pos", "len", "clip_left", "clip_right")


@query(f"WITH {sql.READS} SELECT read_id, least(clip_left, 2) AS clip_left, least(clip_right, 2) AS clip_right FROM reads")
def trim_soft_clips(s, d):
    return sel.trim_soft_clips(views.reads(s, d), 2).select("read_id", "clip_left", "clip_right")


@query(f"WITH {sql.BASES}, c AS (SELECT (qual * 7 + off) % 94 AS q FROM bases) SELECT q, [0, 6, 15, 22, 27, 33, 37, 40][1 + CAST(q > 1 AS INT) + CAST(q > 9 AS INT) + CAST(q > 19 AS INT) + CAST(q > 24 AS INT) + CAST(q > 29 AS INT) + CAST(q > 34 AS INT) + CAST(q > 38 AS INT)] AS out_qual, count(*) AS n FROM c GROUP BY ALL")
def adjust_out_qual(s, d):
    """Qualities of the whole range, 0 to 93."""
    q = F.expr("(qual * 7 + off) % 94")
    return views.bases(s, d).groupBy(q.alias("q"), sel.binned_quality(q).alias("out_qual")).agg(F.count("*").alias("n"))


@query(
    f"WITH {sql.BASES}, c AS (SELECT rg, qual AS q1, {recal('qual', 'off')} AS q2, count(*) AS n FROM bases GROUP BY ALL), "
    "t AS (SELECT rg, sum(n) AS a, sum(n * q1) AS x, sum(n * q2) AS y, sum(n * q1 * q1) AS xx, sum(n * q2 * q2) AS yy, sum(n * q1 * q2) AS xy FROM c GROUP BY rg) "
    "SELECT rg, q1, q2, n, round(CAST(a * xy - x * y AS DOUBLE) * CAST(a * xy - x * y AS DOUBLE) / (CAST(a * xx - x * x AS DOUBLE) * CAST(a * yy - y * y AS DOUBLE)), 6) AS r2 FROM c JOIN t USING (rg)"
)
def quality_transformation(s, d):
    return sel.quality_transformation(views.bases(s, d, "rg"))


@query(f"WITH {sql.READS} SELECT read_id, array_to_string(list_transform(range(0, len), lambda i: {recal('(12 + (k * 7 + i * 3) % 30)', 'i')}), ',') AS quals FROM reads")
def recalibrate_reads(s, d):
    return sel.recalibrate_reads(views.reads(s, d)).select("read_id", F.array_join(F.col("quals").cast("array<string>"), ",").alias("quals"))


@query(
    f"WITH {sql.BASES}, g AS (SELECT *, count(*) OVER (PARTITION BY chrom, site) AS dp FROM bases), k AS (SELECT * FROM g WHERE dp > 1), m AS ("
    + " UNION ALL ".join(f"SELECT rg, '{c}' AS covariate, CAST({c} AS BIGINT) AS value FROM k" for c in ("qual", "off", "mapq", "len", "base"))
    + ") SELECT rg, covariate, value, count(*) AS n FROM m GROUP BY ALL"
)
def recal_covariate_tables(s, d):
    return sel.covariate_table(views.bases(s, d, "rg", "mapq", "len"))


@query(
    f"WITH {sql.BASES}, w AS (SELECT is_rev, ref, base, coalesce(CASE WHEN is_rev = 1 THEN 3 - lead(base) OVER v ELSE lag(base) OVER v END, 4) AS prev FROM bases WINDOW v AS (PARTITION BY uid ORDER BY off)) "
    f"SELECT is_rev, ref, base, {', '.join(f'count_if(prev = {p}) AS prev{p}' for p in range(5))} FROM w GROUP BY ALL"
)
def prev_base_table(s, d):
    return sel.previous_base_table(views.bases(s, d, "is_rev", "turned").withColumnRenamed("turned", "prev"))


@query(f"WITH {sql.PILE}, r AS (SELECT chrom, site, {TOP} AS t FROM pile) SELECT chrom, site, t[1].b AS b1, -t[1].m AS n1, t[2].b AS b2, -t[2].m AS n2 FROM r")
def top2_alleles(s, d):
    return sel.top2_alleles(_pile(s, d))


@query(f"WITH {sql.BASES}, r AS (SELECT chrom, site, base, row_number() OVER (PARTITION BY chrom, site ORDER BY {sql.draw('(read_id * 70 + off)')}, read_id * 70 + off) AS rn, count(*) OVER (PARTITION BY chrom, site) AS depth FROM bases) SELECT chrom, site, base AS call, depth FROM r WHERE rn = 1")
def call_random_base(s, d):
    return sel.random_base(views.bases(s, d))


@query(f"WITH {sql.BASES}, {CAPPED}, c AS (SELECT chrom, site, {FOUR} FROM capped GROUP BY ALL), t AS (SELECT chrom, site, {TOP} AS t FROM c) SELECT chrom, site, t[1].b AS call, -t[1].m AS n FROM t WHERE -t[1].m >= 2")
def call_consensify(s, d):
    return sel.consensus_call(sites.site_depth_cap(views.bases(s, d), 3), 3)


@query(
    f"WITH {sql.PILE}, c AS (SELECT DISTINCT ref_depth, alt_depth, ref_depth + alt_depth AS n FROM pile), i AS (SELECT *, unnest(range(0, CAST(least(ref_depth, alt_depth) + 1 AS BIGINT))) AS i FROM c), "
    "p AS (SELECT ref_depth, alt_depth, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0)))) + 1e-10, 6) AS ai FROM i GROUP BY ALL) "
    "SELECT chrom, site, round(ref_depth / depth, 6) AS ab, ai FROM pile JOIN p USING (ref_depth, alt_depth)"
)
def allele_balance(s, d):
    return sel.allele_balance(_pile(s, d))


_A, _B = (f"[{', '.join(str(g[k]) for g in GENOTYPES)}][genotype + 1]" for k in (0, 1))
_L = "substr('ACGT', CAST({} + 1 AS INT), 1)"


@query(
    f"WITH {sql.LIKELIHOODS}, r AS (SELECT *, list_sort([{', '.join(f'{{m: -logs[{i + 1}], g: {i}}}' for i in range(10))}]) AS r FROM sites), "
    f"c AS (SELECT chrom, site, ref, CAST(r[1].g AS BIGINT) AS genotype FROM r), e AS (SELECT *, {_A} AS a, {_B} AS b FROM c) "
    "SELECT chrom, site, CASE WHEN a = ref AND b = ref THEN '0/0' WHEN a = ref OR b = ref THEN '0/1' WHEN a = b THEN '1/1' ELSE '1/2' END AS gt, "
    f"CASE WHEN a = ref AND b = ref THEN '.' WHEN a = ref THEN {_L.format('b')} WHEN b = ref OR a = b THEN {_L.format('a')} ELSE {_L.format('a')} || ',' || {_L.format('b')} END AS alt FROM e"
)
def call_gt_encode(s, d):
    return sel.encode_genotypes(sites.call_mle(sites.genotype_likelihoods(views.bases(s, d))), GENOTYPES)


@query(f"WITH {sql.READS} SELECT 'one' AS sample, rg, count(*) AS n FROM reads WHERE k % 2 = 0 GROUP BY ALL UNION ALL SELECT 'two', rg, count(*) FROM reads WHERE k % 2 = 1 GROUP BY ALL")
def union_samples(s, d):
    return sel.united({n: views.reads(s, d).where(f"k % 2 = {i}") for i, n in enumerate(("one", "two"))}).groupBy("sample", "rg").agg(F.count("*").alias("n"))


@query(f"WITH {sql.READS} SELECT chrom, pos, read_id FROM reads")
def sort_by_position(s, d):
    return views.reads(s, d).select("chrom", "pos", "read_id").repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos", "read_id")
