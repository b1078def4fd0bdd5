"""Queries on reads, sites and populations, and their SQL.

A query takes (spark, sf_dir). Each SQL text begins with the views it needs, written for any engine with CTEs.
"""

from __future__ import annotations

from math import log

from pyspark.sql import functions as F

from helixmill.operators import intervals, population, reads, sites
from helixmill.plans import sql
from helixmill.plans.registry import THETA, WIN, query
from helixmill.sources import views

# reads


def _filtered(s, d):
    return reads.read_filter(views.reads(s, d), mapq=(10, 50), soft_clip=0.3)


@query(f"WITH {sql.FILTERED} SELECT read_id, coalesce(reason, 'kept') AS reason FROM filtered")
def read_filter(s, d):
    return _filtered(s, d).select("read_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"WITH {sql.FILTERED} SELECT rg, chrom, coalesce(reason, 'kept') AS reason, count(*) AS n FROM filtered GROUP BY ALL")
def filter_audit(s, d):
    return reads.filter_audit(_filtered(s, d))


@query(f"WITH {sql.FILTERED} SELECT read_id, name, reason FROM filtered WHERE reason IS NOT NULL")
def filter_log(s, d):
    return _filtered(s, d).where("reason IS NOT NULL").select("read_id", "name", "reason")


@query(f"WITH {sql.READS} SELECT read_id, CAST(flag & ~1024 AS INT) AS flag FROM reads")
def reset_duplicates(s, d):
    return reads.reset_duplicates(views.reads(s, d)).select("read_id", "flag")


@query(
    f"WITH {sql.READS}, u AS (SELECT read_id, pos, frag, lag(pos) OVER v AS p, lag(pos + frag) OVER v AS e FROM reads WHERE flag & 1024 = 0 WINDOW v AS (PARTITION BY rg, chrom ORDER BY pos, read_id, frag)) "
    "SELECT read_id, CASE WHEN pos - p <= 2 AND abs(pos + frag - e) <= 2 THEN 1 ELSE 0 END AS is_dup FROM u UNION ALL SELECT read_id, 1 FROM reads WHERE flag & 1024 > 0"
)
def mark_duplicates(s, d):
    return reads.mark_duplicates(views.reads(s, d), 2).select("read_id", "is_dup")


@query(
    f"WITH {sql.READS}, s AS (SELECT * REPLACE (pos // 20 * 20 AS pos) FROM reads), w AS (SELECT *, lag(pos) OVER v AS p, lag(frag) OVER v AS f, lag(read_id) OVER v AS previous_id, lag(is_rev) OVER v AS previous_rev FROM s WINDOW v AS (PARTITION BY rg, chrom ORDER BY pos, read_id, frag)) "
    "SELECT rg, chrom, pos, frag, is_rev, read_id, previous_id, previous_rev FROM w WHERE p = pos AND f = frag"
)
def potential_duplicates(s, d):
    """Of reads whose starts are in steps of 20, so that there are some."""
    return reads.potential_duplicates(views.reads(s, d).withColumn("pos", F.expr("pos div 20 * 20")))


@query(
    f"WITH {sql.READS}, w AS (SELECT rg, least(10000, pos - lag(pos) OVER (PARTITION BY rg, chrom ORDER BY pos, read_id)) AS distance, lag(pos) OVER (PARTITION BY rg, chrom ORDER BY pos, read_id) AS p FROM reads) "
    "SELECT rg, distance, count(*) AS n FROM w WHERE p IS NOT NULL GROUP BY ALL"
)
def read_distance(s, d):
    return reads.read_distance(views.reads(s, d))


@query(f"WITH {sql.READS}, g AS (SELECT rg, count(*) AS reads_at_start FROM reads GROUP BY rg, chrom, pos) SELECT rg, reads_at_start, count(*) AS n FROM g GROUP BY ALL")
def start_multiplicity(s, d):
    return reads.start_multiplicity(views.reads(s, d))


@query(f"WITH {sql.READS} SELECT chrom, CAST(sum(len) AS BIGINT) AS aligned, round(sum(len) / 50000.0, 6) AS depth FROM reads GROUP BY chrom")
def average_depth(s, d):
    return reads.average_depth(views.reads(s, d), views.GENOME)


@query(
    f"WITH {sql.READS} SELECT 'left' AS clip_end, len, clip_left AS clipped, count(*) AS n FROM reads GROUP BY ALL UNION ALL SELECT 'right', len, clip_right, count(*) FROM reads GROUP BY ALL "
    "UNION ALL SELECT 'both', len, clip_left + clip_right, count(*) FROM reads GROUP BY ALL"
)
def soft_clip_matrix(s, d):
    return reads.soft_clip_matrix(views.reads(s, d))


@query(
    f"WITH {sql.READS} SELECT rg, count_if((flag & 1 = 0 AND flag & 194 > 0) OR (flag & 1 > 0 AND (flag & 64 > 0) = (flag & 128 > 0)) OR (flag & 4 > 0 AND flag & 2 > 0)) AS n_odd, count(*) AS n FROM reads GROUP BY rg"
)
def flag_audit(s, d):
    return reads.flag_audit(views.reads(s, d))


@query(f"WITH {sql.READS} SELECT read_id, CAST(flag & ~235 AS INT) AS flag FROM reads WHERE flag & 1 = 0 OR flag & 64 > 0")
def make_single(s, d):
    return reads.make_single(views.reads(s, d)).select("read_id", "flag")


@query(f"WITH {sql.READS} SELECT CASE rg WHEN 'R' THEN 'A' ELSE rg END AS rg, count(*) AS n FROM reads GROUP BY ALL")
def merge_read_groups(s, d):
    return reads.merge_read_groups(views.reads(s, d), {"A": ["R"]}).groupBy("rg").agg(F.count("*").alias("n"))


@query(f"WITH {sql.READS} SELECT read_id FROM reads WHERE {sql.draw('read_id')} < 0.25")
def sample_reads(s, d):
    return reads.sample_reads(views.reads(s, d), 0.25).select("read_id")


@query(f"WITH {sql.READS} SELECT read_id, 0.5 AS p FROM reads WHERE {sql.draw('name', 0)} < 0.5 UNION ALL SELECT read_id, 0.1 FROM reads WHERE {sql.draw('name', 1)} < 0.1")
def downsample_reads(s, d):
    return reads.downsample_reads(views.reads(s, d), [0.5, 0.1]).select("read_id", "p")


@query(f"WITH {sql.READS}, u AS (SELECT read_id, {sql.draw('name')} AS u FROM reads) SELECT read_id, CASE WHEN u < 0.3 THEN 0 WHEN u < 0.8 THEN 1 ELSE -1 END AS part FROM u")
def split_reads(s, d):
    return reads.split_reads(views.reads(s, d), [0.3, 0.5]).select("read_id", F.coalesce("part", F.lit(-1)).alias("part"))


@query(f"WITH {sql.PAIRS} SELECT name, rg, chrom, pos1, len1, pos2, len2, status FROM pairs")
def pair_mates(s, d):
    return reads.pair_mates(views.pairs_source(s, d))


@query(f"WITH {sql.READS}, {sql.REGIONS}, {sql.MERGED} SELECT read_id FROM reads r WHERE EXISTS (SELECT 1 FROM merged g WHERE g.chrom = r.chrom AND r.pos < g.stop AND r.pos + r.len > g.start)")
def reads_x_regions(s, d):
    return reads.reads_x_regions(views.reads(s, d), views.regions(s, d)).select("read_id")


# intervals


@query(f"WITH {sql.REGIONS}, {sql.MERGED} SELECT chrom, start, stop FROM merged")
def bed_merge(s, d):
    return intervals.bed_merge(views.regions(s, d))


@query(
    f"WITH {sql.REGIONS}, {sql.MERGED}, e AS (SELECT chrom, start, stop FROM merged UNION ALL SELECT c, 0, 0 FROM (VALUES (1), (2), (3)) v(c) UNION ALL SELECT c, 50000, 50000 FROM (VALUES (1), (2), (3)) v(c)), "
    "n AS (SELECT chrom, stop, lead(start) OVER (PARTITION BY chrom ORDER BY start, stop) AS nx FROM e) SELECT CAST(chrom AS BIGINT) AS chrom, stop AS start, nx AS stop FROM n WHERE nx > stop"
)
def regions_complement(s, d):
    return intervals.regions_complement(views.regions(s, d), views.GENOME, s.range(1, 4).withColumnRenamed("id", "chrom"))


# sites


@query(f"WITH {sql.PILE} SELECT chrom, site, ref, depth, na, nc, ng, nt, n_alleles, ref_depth, alt_depth FROM pile")
def pileup(s, d):
    return sites.pileup(views.bases(s, d))


@query(f"WITH {sql.BASES} SELECT chrom, site, count_if(is_rev = 0) AS n_forward, count_if(is_rev = 1) AS n_reverse FROM bases GROUP BY ALL")
def strand_mate_counts(s, d):
    return sites.strand_mate_counts(views.bases(s, d, "is_rev"))


@query(f"WITH {sql.BASES} SELECT chrom, site, CAST(floor(sqrt(avg(mapq * mapq))) AS BIGINT) AS rms_mapq FROM bases GROUP BY ALL")
def rms_mapq(s, d):
    return sites.rms_mapq(views.bases(s, d, "mapq"))


@query(f"WITH {sql.BASES} SELECT chrom, site, count(*) AS n FROM bases WHERE qual BETWEEN 20 AND 35 GROUP BY ALL")
def base_quality_filter(s, d):
    return sites.base_quality_filter(views.bases(s, d), 20, 35).groupBy("chrom", "site").agg(F.count("*").alias("n"))


@query(f"WITH {sql.BASES}, e AS (SELECT *, CASE WHEN is_rev = 1 THEN len - 1 - off ELSE off END AS d5 FROM bases) SELECT chrom, site, count(*) AS depth, count_if(d5 >= 3 AND len - 1 - d5 >= 2) AS n FROM e GROUP BY ALL")
def trim_ends(s, d):
    return sites.trim_ends(views.bases(s, d, "is_rev", "len"), 3, 2).groupBy("chrom", "site").agg(F.count("*").alias("depth"), F.count_if(F.col("base") < 4).alias("n"))


@query(f"WITH {sql.PILE} SELECT chrom, depth, count(*) AS n FROM (SELECT chrom, site, sum(depth) AS depth FROM pile GROUP BY ALL) GROUP BY ALL")
def depth_histogram(s, d):
    return sites.depth_histogram(views.bases(s, d))


@query(f"WITH {sql.BASES}, c AS (SELECT qual, coalesce(lag(base) OVER (PARTITION BY uid ORDER BY off), 4) AS prev, base FROM bases) SELECT qual, prev, base, count(*) AS n FROM c GROUP BY ALL")
def context_table(s, d):
    return sites.context_table(views.bases(s, d, "prev"))


@query(
    f"WITH {sql.PILE} SELECT chrom, site // {WIN} AS win, count(*) AS n_sites, round(sum(depth) / {WIN}.0, 6) AS mean_depth, round(1 - count(*) / {WIN}.0, 6) AS missing, count_if(depth >= 2) AS n_depth2 FROM pile GROUP BY ALL"
)
def window_depth_stats(s, d):
    return sites.window_depth_stats(views.bases(s, d), WIN)


@query(
    f"WITH {sql.PILE} SELECT chrom, site // {WIN} AS win, round(avg(na / depth), 6) AS f_a, round(avg(nc / depth), 6) AS f_c, round(avg(ng / depth), 6) AS f_g, round(avg(nt / depth), 6) AS f_t FROM pile GROUP BY ALL"
)
def base_frequencies_window(s, d):
    return sites.base_frequencies_window(views.bases(s, d), WIN)


@query(f"WITH {sql.BASES} SELECT chrom, site, CAST(sum(qual) AS BIGINT) AS q, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY chrom, site ORDER BY read_id, qual, base) AS rn FROM bases) WHERE rn <= 5 GROUP BY ALL")
def site_depth_cap(s, d):
    return sites.site_depth_cap(views.bases(s, d), 5).groupBy("chrom", "site").agg(F.sum("qual").alias("q"), F.count("*").alias("n"))


@query(f"WITH {sql.PILE} SELECT chrom, site, depth FROM pile WHERE depth BETWEEN 5 AND 20")
def site_depth_filter(s, d):
    return sites.site_depth_filter(sites.pileup(views.bases(s, d)), 5, 20).select("chrom", "site", "depth")


@query(
    f"WITH {sql.PILE}, c AS (SELECT na, nc, ng, nt, count(*) AS n FROM pile GROUP BY ALL) SELECT *, CAST(list_position([na, nc, ng, nt], greatest(na, nc, ng, nt)) - 1 AS BIGINT) AS major, greatest(na, nc, ng, nt) AS major_depth FROM c"
)
def allelic_depth_table(s, d):
    return sites.allelic_depth_table(sites.pileup(views.bases(s, d)))


@query(f"WITH {sql.LIKELIHOODS} SELECT chrom, site, ref, depth, {', '.join(f'round(gl[{i + 1}], 6) AS g{i}' for i in range(10))} FROM sites")
def genotype_likelihoods(s, d):
    rows = sites.genotype_likelihoods(views.bases(s, d))
    return rows.select("chrom", "site", "ref", "depth", *(F.round(F.element_at("gl", i + 1), 6).alias(f"g{i}") for i in range(10)))


@query(
    f"WITH {sql.LIKELIHOODS}, r AS (SELECT *, list_sort([{', '.join(f'{{m: -logs[{i + 1}], g: {i}}}' for i in range(10))}]) AS r FROM sites) "
    "SELECT chrom, site, ref, depth, CAST(r[1].g AS BIGINT) AS genotype, round((r[2].m - r[1].m) * 10 / ln(10.0), 3) AS gq FROM r"
)
def call_mle(s, d):
    return sites.call_mle(sites.genotype_likelihoods(views.bases(s, d)))


@query(
    f"WITH {sql.PILE}, r AS (SELECT chrom, site, list_sort([{', '.join(f'{{m: -n{b}, h: (site * 7 + {k * 13}) % 11, b: {k}}}' for k, b in enumerate('acgt'))}])[1] AS t FROM pile) SELECT chrom, site, CAST(t.b AS BIGINT) AS call, -t.m AS ad FROM r"
)
def call_majority(s, d):
    return sites.call_majority(sites.pileup(views.bases(s, d)))


_GRID = [-5 + 4 * i / 4 for i in range(5)]


@query(
    f"WITH {sql.LIKELIHOODS} "
    + " UNION ALL ".join(
        f"SELECT chrom, site // {WIN} AS win, {round(x, 6)} AS log10_theta, round(sum(ln({' + '.join(f'gl[{i + 1}] * {p!r}' for i, p in enumerate(sites.theta_prior(10**x)))})), 3) AS ll FROM sites GROUP BY ALL" for x in _GRID
    )
)
def theta_surface(s, d):
    return sites.theta_surface(sites.genotype_likelihoods(views.bases(s, d)), WIN, 5)


@query(sql.mutation_load(3))
def mutation_load(s, d):
    return sites.mutation_load(sites.genotype_likelihoods(views.bases(s, d)), 3)


@query(
    f"WITH {sql.posterior(sites.theta_prior(THETA))}, b AS (SELECT chrom, site // 100 AS block, sum(ln(post[1] + post[5] + post[8] + post[10])) AS s FROM posts GROUP BY ALL) "
    f"SELECT chrom, block, CASE WHEN s > {log(0.99)!r} THEN 'T' WHEN s < {log(1 - 0.99)!r} THEN 'K' ELSE 'N' END AS code FROM b"
)
def psmc_blocks(s, d):
    return sites.psmc_blocks(sites.genotype_likelihoods(views.bases(s, d)), sites.theta_prior(THETA))


def _mask(kind: str, test: str):
    def run(s, d):
        return sites.mask(sites.pileup(views.bases(s, d)), kind, 3)

    run.__name__ = f"mask_{kind}"
    query(f"WITH {sql.PILE}, g AS (SELECT chrom, site, site - row_number() OVER (PARTITION BY chrom ORDER BY site) AS g FROM pile WHERE depth >= 3 AND {test}) SELECT chrom, min(site) AS start, max(site) + 1 AS stop FROM g GROUP BY chrom, g")(run)


_mask("invariant", "n_alleles = 1")
_mask("variant", "n_alleles > 1")
_mask("nonref", "alt_depth > 0")


@query(
    f"WITH {sql.PILE}, f AS (SELECT v.c AS chrom, r.range AS site FROM (VALUES (1), (2), (3)) v(c), range(0, 50000) r), b AS (SELECT f.chrom, f.site FROM f LEFT JOIN pile p ON p.chrom = f.chrom AND p.site = f.site WHERE coalesce(depth, 0) < 5 OR depth > 12), "
    "g AS (SELECT chrom, site, site - row_number() OVER (PARTITION BY chrom ORDER BY site) AS g FROM b) SELECT CAST(chrom AS BIGINT) AS chrom, min(site) AS start, max(site) + 1 AS stop FROM g GROUP BY chrom, g"
)
def mask_depth(s, d):
    pile = sites.pileup(views.bases(s, d)).where(F.col("site") < views.GENOME)
    return sites.mask_depth(pile, views.GENOME, s.range(1, 4).withColumnRenamed("id", "chrom"), 5, 12)


@query(
    f"WITH {sql.BASES}, {sql.ALLELES}, c AS (SELECT read_id, max(CAST(base = known_ref AS INT)) AS r, max(CAST(base = known_alt AS INT)) AS a FROM bases JOIN alleles USING (chrom, site) GROUP BY read_id) "
    "SELECT read_id, CASE WHEN r = 1 AND a = 1 THEN 'both' WHEN r = 1 THEN 'ref' WHEN a = 1 THEN 'alt' ELSE 'other' END AS class FROM c"
)
def reads_x_alleles(s, d):
    return sites.sites_x_alleles(views.bases(s, d), views.alleles(s, d))


# populations


@query(f"WITH {sql.GL} SELECT a.sample AS s1, b.sample AS s2, count(*) AS n, round(avg(CAST(a.gt <> b.gt AS DOUBLE)), 6) AS f2 FROM gl a JOIN gl b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample < b.sample GROUP BY ALL")
def f2(s, d):
    return population.f2(views.genotypes(s, d))


@query(f"WITH {sql.GL} SELECT chrom, pos, pop, count(*) AS n, CAST(2 * count(*) - sum(gt) AS BIGINT) AS n_a, count_if(gt = 1) AS n_ab FROM gl GROUP BY ALL")
def pop_genotype_counts(s, d):
    return population.pop_genotype_counts(views.genotypes(s, d))


@query(sql.HWE)
def hwe_test(s, d):
    return population.hwe_test(population.pop_genotype_counts(views.genotypes(s, d)))


@query(
    f"WITH {sql.GL} SELECT chrom, pos, "
    + ", ".join(f"CASE WHEN count_if(pop = {p}) > 0 THEN CAST(CAST(sum(gt) FILTER (pop = {p}) AS BIGINT) AS VARCHAR) || '/' || CAST(2 * count_if(pop = {p}) AS VARCHAR) ELSE '0/0' END AS pop{p}" for p in range(3))
    + " FROM gl GROUP BY ALL"
)
def f_table_reshape(s, d):
    return population.f_table(views.genotypes(s, d), [0, 1, 2])


@query(
    f"WITH {sql.NORMAL} "
    + " UNION ALL ".join(f"SELECT pop, {round(f, 6)} AS freq, round(sum(ln(l0 * {(1 - f) ** 2!r} + l1 * {2 * f * (1 - f)!r} + l2 * {f * f!r})), 3) AS ll FROM normal GROUP BY pop" for f in [(i + 0.5) / 5 for i in range(5)])
)
def allele_freq_surface(s, d):
    return population.allele_freq_surface(views.genotypes(s, d))


@query(sql.hw_em(3))
def allele_freq_hw(s, d):
    return population.allele_freq_hw(views.genotypes(s, d), 3)


@query(
    f"WITH {sql.GL}, l AS (SELECT chrom, pos, CASE WHEN min(gt) = max(gt) AND min(gt) <> 1 THEN 1 ELSE 0 END AS inv FROM gl GROUP BY ALL), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY pos) - row_number() OVER (PARTITION BY chrom, inv ORDER BY pos) AS r FROM l) SELECT chrom, min(pos) AS start, max(pos) + 1 AS stop, count(*) AS n FROM r WHERE inv = 1 GROUP BY chrom, r"
)
def invariant_intervals(s, d):
    return population.invariant_intervals(views.genotypes(s, d))


@query(f"WITH {sql.GL} SELECT * FROM (SELECT chrom, pos, sample, dp, row_number() OVER (PARTITION BY chrom, pos ORDER BY dp DESC, sample) AS rank FROM gl) WHERE rank <= 3")
def topk_samples_by_depth(s, d):
    return population.topk_samples_by_depth(views.genotypes(s, d), 3)


@query(f"WITH {sql.GL} SELECT chrom, pos, " + " || ".join(f"coalesce(CAST(2 - max(gt) FILTER (sample = {k}) AS VARCHAR), '9')" for k in range(12)) + " AS line FROM gl GROUP BY ALL")
def to_geno(s, d):
    return population.to_geno(views.genotypes(s, d), 12)


@query(f"WITH {sql.NORMAL} SELECT chrom, pos, sample, round(l1 + 2 * l2, 6) AS dosage FROM normal")
def allele_dosage(s, d):
    return population.allele_dosage(views.genotypes(s, d))


@query()
def to_beagle(s, d):
    return population.to_beagle(views.genotypes(s, d), 12)


@query(
    f"WITH {sql.GL}, t AS (SELECT chrom, pos, CAST(sum(gt) AS BIGINT) AS alt, 2 * count(*) AS total FROM gl GROUP BY ALL) SELECT *, CASE WHEN least(alt, total - alt) <= 4 AND total >= 12 THEN CASE WHEN 2 * alt > total THEN 1 ELSE 0 END ELSE -1 END AS ancestral FROM t"
)
def ancestral_alleles(s, d):
    return population.ancestral_alleles(views.genotypes(s, d), 4, 12)
