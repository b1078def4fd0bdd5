"""Queries of references, regions, samples, pairs and files, with their SQL."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from helixmill.operators import loci, population, reads, selection, sites
from helixmill.plans import sql
from helixmill.plans.registry import THETA, WIN, query
from helixmill.sources import files, views

PER_SAMPLE = (
    sql.LIKELIHOODS.replace("SELECT chrom, site, ref, base, ln(", "SELECT rg, chrom, site, ref, base, ln(").replace("sums AS (SELECT chrom,", "sums AS (SELECT rg, chrom,").replace("logs AS (SELECT chrom,", "logs AS (SELECT rg, chrom,")
)

#: The draw of a read and a place in it.
_DRAW = sql.draw("off", 0).replace("0 * 48271", "((read_id * 69621 + 12345) % 2147483647) * 48271")


def _by_sample(s, d):
    """Genotype likelihoods of each read group, taken as a sample."""
    return sites.genotype_likelihoods(views.bases(s, d, "rg"), "rg")


@query(f"WITH {sql.PAIRS} SELECT name, rg, chrom, 1 AS mate, pos1 AS pos, len1 AS len FROM pairs WHERE status = 'pair' UNION ALL SELECT name, rg, chrom, 2, pos2, len2 FROM pairs WHERE status = 'pair'")
def pairs_listing(s, d):
    return loci.pairs_listing(reads.pair_mates(views.pairs_source(s, d)))


@query(f"WITH {sql.BASES}, n AS (SELECT CASE WHEN {_DRAW} < 0.2 THEN 4 ELSE base END AS base FROM bases) SELECT base, count(*) AS n FROM n GROUP BY base")
def downsample_bases(s, d):
    return loci.downsample_bases(views.bases(s, d), 0.2).groupBy("base").agg(F.count("*").alias("n"))


@query(f"WITH {sql.PILE}, g AS (SELECT chrom, site, site - row_number() OVER (PARTITION BY chrom ORDER BY site) AS g FROM pile WHERE depth BETWEEN 4 AND 9) SELECT chrom, min(site) AS start, max(site) + 1 AS stop FROM g GROUP BY chrom, g")
def pileup_to_bed(s, d):
    return loci.pileup_to_bed(sites.pileup(views.bases(s, d)), 4, 9)


@query(f"WITH {sql.BASES}, r AS (SELECT DISTINCT chrom, site, ref FROM bases WHERE site % 2 = 0) SELECT b.chrom, coalesce(r.ref, 4) AS ref, b.base, count(*) AS n FROM bases b LEFT JOIN r ON b.chrom = r.chrom AND b.site = r.site GROUP BY ALL")
def bases_x_reference(s, d):
    reference = views.bases(s, d).where("site % 2 = 0").select("chrom", "site", "ref").distinct()
    return loci.bases_x_reference(views.bases(s, d), reference).groupBy("chrom", "ref", "base").agg(F.count("*").alias("n"))


@query(
    f"WITH {sql.PILE}, {sql.REGIONS}, r AS (SELECT DISTINCT CAST(start % 2 AS INT) AS part, chrom, unnest(range(start, stop)) AS site FROM regions) SELECT part, chrom, site, depth FROM pile JOIN r USING (chrom, site)"
)
def sites_x_regions(s, d):
    pile, r = sites.pileup(views.bases(s, d)).select("chrom", "site", "depth"), views.regions(s, d)
    parts = [selection.sites_in_regions(pile, r.where(F.col("start") % 2 == k)).withColumn("part", F.lit(k)) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


@query(f"WITH {sql.BASES}, u AS (SELECT DISTINCT rg, chrom, site FROM bases) SELECT a.rg AS s1, b.rg AS s2, count(*) AS n FROM u a JOIN u b ON a.chrom = b.chrom AND a.site = b.site AND a.rg < b.rg GROUP BY ALL")
def common_sites(s, d):
    return loci.common_sites(views.bases(s, d, "rg"), "rg")


@query(
    f"WITH {sql.BASES}, o AS (SELECT chrom, site, count(*) AS n, count_if(base <> ref) AS k FROM bases WHERE ref IN (0, 3) GROUP BY ALL HAVING count_if(base <> ref) >= 2 AND 2 * count_if(base <> ref) <= count(*)), "
    f"r AS (SELECT chrom, site, off, row_number() OVER (PARTITION BY chrom, site ORDER BY {_DRAW}, read_id, off) AS i FROM bases JOIN o USING (chrom, site) WHERE base <> ref) "
    "SELECT a.off AS first, b.off AS second, count(*) AS n FROM r a JOIN r b ON a.chrom = b.chrom AND a.site = b.site AND a.i = 1 AND b.i = 2 GROUP BY ALL"
)
def from_to_table(s, d):
    return loci.from_to_table(views.bases(s, d))


_W = [f"f{a} * ({exp(-THETA)!r} + f{a} * {1 - exp(-THETA)!r})" if a == b else f"2 * f{a} * f{b} * {1 - exp(-THETA)!r}" for a, b in sql.GENOTYPES]


@query(
    f"WITH {sql.PILE}, f AS (SELECT chrom, site // {WIN} AS win, round(avg(na / depth), 6) AS f0, round(avg(nc / depth), 6) AS f1, round(avg(ng / depth), 6) AS f2, round(avg(nt / depth), 6) AS f3 FROM pile GROUP BY ALL) "
    f"SELECT chrom, win, {', '.join(f'round(({w}) / ({" + ".join(_W)}), 6) AS p{i}' for i, w in enumerate(_W))} FROM f"
)
def genotype_prior(s, d):
    return loci.window_priors(sites.base_frequencies_window(views.bases(s, d), WIN), THETA)


@query(f"WITH {sql.LIKELIHOODS}, r AS (SELECT chrom, site, list_sort([{', '.join(f'{{m: -round(logs[{i + 1}], 9), g: {i}}}' for i in range(10))}]) AS r FROM sites) SELECT chrom, site, CAST(r[1].g AS BIGINT) AS best, CAST(r[2].g AS BIGINT) AS second FROM r")
def top2_genotypes(s, d):
    rows = sites.genotype_likelihoods(views.bases(s, d))
    return loci.top2_genotypes(rows.withColumn("logs", F.transform("logs", lambda x: F.round(x, 9))))


@query(f"WITH {sql.PILE} SELECT chrom, site, depth FROM pile ORDER BY chrom, site LIMIT 100")
def limit_rows(s, d):
    return selection.first_rows(sites.pileup(views.bases(s, d)).select("chrom", "site", "depth"), 100, "chrom", "site")


@query(f"WITH {sql.NORMAL} SELECT chrom, pos, sample, round(l0, 6) AS l0, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM normal")
def normalise_gl(s, d):
    return population.likelihoods(views.genotypes(s, d)).select("chrom", "pos", "sample", *(F.round(f"l{k}", 6).alias(f"l{k}") for k in range(3)))


@query(
    f"WITH {sql.BASES}, {sql.ALLELES}, ref AS (SELECT DISTINCT chrom, site, ref FROM bases), a AS (SELECT chrom, site, unnest(range(site - 5, site + 6)) AS spot FROM alleles) "
    "SELECT a.chrom, a.site, string_agg(coalesce(substr('ACGT', CAST(ref.ref + 1 AS INT), 1), 'N'), '' ORDER BY spot) AS flank FROM a LEFT JOIN ref ON a.chrom = ref.chrom AND a.spot = ref.site GROUP BY ALL"
)
def liftover_flanks(s, d):
    return loci.flanks(views.alleles(s, d), views.bases(s, d).select("chrom", "site", "ref").distinct(), 5)


_PAIR = [f"sum(ln(0.25 * gl[{sql.GENOTYPES.index((a, a)) + 1}] + 0.5 * gl[{sql.GENOTYPES.index((a, b)) + 1}] + 0.25 * gl[{sql.GENOTYPES.index((b, b)) + 1}]))" for a, b in loci.PAIRS]


@query(
    f"WITH {PER_SAMPLE}, p AS (SELECT chrom, site, count(*) AS n_samples, [{', '.join(_PAIR)}] AS l FROM sites GROUP BY ALL) SELECT chrom, site, n_samples, CAST(list_position(list_transform(l, lambda x: round(x, 9)), list_max(list_transform(l, lambda x: round(x, 9)))) - 1 AS BIGINT) AS allele_pair, round(list_max(l), 6) AS ll FROM p"
)
def major_minor_skotte(s, d):
    return loci.major_minor(_by_sample(s, d))


@query(f"WITH {sql.GL} SELECT chrom, pos, sample, dp, gt FROM gl")
def write_tables(s, d):
    path = files.scratch(s)
    files.write_table(views.genotypes(s, d).select("chrom", "pos", "sample", "dp", "gt"), path)
    return files.read_table(s, path, "chrom bigint, pos bigint, sample bigint, dp bigint, gt int")
