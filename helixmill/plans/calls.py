"""Queries of merging, tables, calls and models in their full forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.functions.likelihood import GENOTYPES
from helixmill.operators import inference, loci, models, population, reads, selection, sites
from helixmill.plans import sql
from helixmill.plans.inference import _HELD, _ended, _modelled, with_models
from helixmill.plans.registry import THETA, WIN, query
from helixmill.plans.scans import _calls
from helixmill.sources import files, views

# reads

_REASON = (
    "CASE WHEN len NOT BETWEEN 0 AND 65 THEN 'MappedLength' WHEN flag & 1024 > 0 THEN 'Duplicate' WHEN (clip_left + clip_right) / (len + clip_left + clip_right) > 0.3 THEN 'SoftClipped' WHEN ds >= 4 THEN 'PMDS' "
    "WHEN flag & 1 > 0 AND flag & 2 = 0 THEN 'ImproperPairs' WHEN flag & 4 > 0 THEN 'Unmapped' WHEN flag & 512 > 0 THEN 'FailedQC' WHEN flag & 256 > 0 THEN 'Secondary' WHEN flag & 2048 > 0 THEN 'Supplementary' "
    "WHEN rg NOT IN ('A', 'N') THEN 'ReadGroup' {strand} {mate} WHEN mapq NOT BETWEEN 10 AND 55 THEN 'MappingQuality' WHEN listed THEN 'Blacklist' WHEN len + clip_left + clip_right NOT BETWEEN 25 AND 60 THEN 'ReadLength' "
    "WHEN frag NOT BETWEEN 26 AND 110 THEN 'FragmentLength' WHEN flag & 2 > 0 AND abs(tlen) < len THEN 'LongerThanFragment' WHEN k % 10 = 3 THEN 'External' ELSE 'kept' END"
)
_SETS = {
    "reverse first": _REASON.format(strand="WHEN flag & 16 = 0 THEN 'FwdStrand'", mate="WHEN flag & 64 = 0 THEN 'FirstMate'"),
    "forward second": _REASON.format(strand="WHEN flag & 16 > 0 THEN 'RevStrand'", mate="WHEN flag & 128 = 0 THEN 'SecondMate'"),
    "any": _REASON.format(strand="", mate=""),
}
_TAGGED = f"{sql.READS}, t AS (SELECT r.*, CASE WHEN k % 3 > 0 THEN k % 11 - 5.0 END AS ds, EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = r.name AND o.o_custkey % 7 = 0) AS listed FROM reads r)"


@query(f"WITH {_TAGGED} " + " UNION ALL ".join(f"SELECT '{n}' AS filters, {c} AS reason, count(*) AS n FROM t GROUP BY ALL" for n, c in _SETS.items()) + " UNION ALL SELECT 'none', CASE WHEN len NOT BETWEEN 0 AND 65 THEN 'MappedLength' ELSE 'kept' END, count(*) FROM t GROUP BY ALL")
def read_filters(s, d):
    """Counts by reason under all twenty filters, for both strands and mates, and with filters off."""
    rows = views.reads(s, d).withColumn("ds", F.expr("CASE WHEN k % 3 > 0 THEN CAST(k % 11 - 5 AS DOUBLE) END"))
    names = views.load(s, d, "orders").where("o_custkey % 7 = 0").select(F.col("o_orderkey").alias("name"))
    common = {"mapped_length": (0, 65), "mapq": (10, 55), "length": (25, 60), "soft_clip": 0.3, "groups": ["A", "N"], "pmds": 4.0, "blacklist": names, "fragment": (26, 110), "longer_than_fragment": True, "external": F.expr("k % 10 <> 3")}
    sets = {"reverse first": {"strand": "reverse", "mate": "first"}, "forward second": {"strand": "forward", "mate": "second"}, "any": {}, "none": {"keep_all": True}}
    out = None
    for name, more in sets.items():
        part = reads.read_filter(rows, **common, **more).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n")).withColumn("filters", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_CLASS = (
    "CASE WHEN rev1 = rev2 THEN CASE WHEN rev1 = 0 THEN 'both_forward' ELSE 'both_reverse' END WHEN rs < fs THEN 'rev_starts_first' WHEN re < fe THEN 'rev_ends_first' WHEN fe <= rs THEN 'no_overlap' ELSE 'overlap' END"
)
_LOST = {"middle": "o // 2 + CASE WHEN rev1 = 0 THEN o % 2 ELSE 0 END", "random": f"CASE WHEN {sql.draw('name')} < 0.5 THEN o ELSE 0 END", "keepFirst": "CASE WHEN rev1 = 0 THEN 0 ELSE o END", "keepSecond": "CASE WHEN rev1 = 0 THEN o ELSE 0 END", "keepFwd": "0", "keepRev": "o"}


@query(
    f"WITH {sql.PAIRS}, v AS (SELECT *, CASE WHEN name % 13 = 0 THEN 1 ELSE 0 END AS rev1, CASE WHEN name % 17 = 0 THEN 0 WHEN name % 13 = 0 AND name % 2 = 0 THEN 0 ELSE 1 END AS rev2 FROM pairs WHERE status = 'pair'), "
    "e AS (SELECT *, CASE WHEN rev1 = 0 THEN pos1 ELSE pos2 END AS fs, CASE WHEN rev1 = 0 THEN pos1 + len1 ELSE pos2 + len2 END AS fe, CASE WHEN rev1 = 0 THEN pos2 ELSE pos1 END AS rs, CASE WHEN rev1 = 0 THEN pos2 + len2 ELSE pos1 + len1 END AS re FROM v), "
    f"c AS (SELECT *, {_CLASS} AS class FROM e), o AS (SELECT *, CASE WHEN class = 'overlap' THEN fe - rs ELSE 0 END AS o FROM c) "
    + " UNION ALL ".join(f"SELECT '{m}' AS method, name, rg, chrom, class, class IN ('overlap', 'no_overlap') AS kept, CAST({x} AS BIGINT) AS f_clip, CAST(o - ({x}) AS BIGINT) AS r_clip FROM o" for m, x in _LOST.items())
)
def merge_overlapping_mates(s, d):
    """All six methods."""
    pairs = reads.pair_mates(views.pairs_source(s, d)).withColumns({"rev1": F.expr("CASE WHEN name % 13 = 0 THEN 1 ELSE 0 END"), "rev2": F.expr("CASE WHEN name % 17 = 0 THEN 0 WHEN name % 13 = 0 AND name % 2 = 0 THEN 0 ELSE 1 END")})
    out = None
    for m in reads.MERGING:
        part = reads.merge_overlapping_mates(pairs, m).withColumn("method", F.lit(m))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"WITH {sql.FILTERED} SELECT coalesce(rg, 'all') AS rg, coalesce(chrom, 0) AS chrom, count(*) AS n, count_if(reason IS NULL) AS n_passed, count_if(flag & 1024 > 0) AS n_duplicates, count_if(flag & 2 > 0) AS n_proper, count_if(flag & 1 > 0) AS n_paired, "
    "max(len) AS max_length, round(avg(len), 6) AS mean_length, round(avg(mapq), 6) AS mean_mapq, round(avg(clip_left + clip_right), 6) AS mean_clip, round(avg(frag), 6) AS mean_fragment FROM filtered GROUP BY CUBE (rg, chrom)"
)
def bam_diagnostics(s, d):
    return reads.bam_diagnostics(reads.read_filter(views.reads(s, d), mapq=(10, 50), soft_clip=0.3))


_MEASURES = {"length": "len", "mapq": "mapq", "clip": "clip_left + clip_right", "fragment": "frag"}


@query(
    f"WITH {sql.READS}, m AS (" + " UNION ALL ".join(f"SELECT rg, CASE WHEN flag & 1 = 0 THEN 0 WHEN flag & 128 > 0 THEN 2 ELSE 1 END AS mate, CAST(flag & 16 > 0 AS INT) AS is_rev, '{m}' AS measure, {c} AS value FROM reads" for m, c in _MEASURES.items()) + ") "
    "SELECT rg, mate, is_rev, measure, value, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'all', mate, is_rev, measure, value, count(*) FROM m GROUP BY mate, is_rev, measure, value"
)
def bam_histograms(s, d):
    return reads.bam_histograms(views.reads(s, d))


# bases

_DISTS = "CASE WHEN is_rev = 1 THEN len - 1 - off ELSE off END AS d5, CASE WHEN is_rev = 1 THEN off ELSE len - 1 - off END + CASE WHEN flag & 2 > 0 THEN frag - len ELSE 0 END AS d3"


def _distances(s, d):
    rows = views.bases(s, d, "is_rev", "len", "frag", "flag").withColumn("proper", (F.col("flag").bitwiseAND(F.lit(2)) > 0).cast("int"))
    return selection.end_distances(rows, paired=True)


@query(f"WITH {sql.BASES}, e AS (SELECT is_rev, CAST(flag & 2 > 0 AS INT) AS proper, {_DISTS} FROM bases) SELECT is_rev, proper, d5, d3, count(*) AS n FROM e GROUP BY ALL")
def end_distances(s, d):
    return _distances(s, d).groupBy("is_rev", "proper", "d5", "d3").agg(F.count("*").alias("n"))


@query(
    f"WITH {sql.BASES}, e AS (SELECT CASE WHEN flag & 1 = 0 THEN 0 WHEN flag & 128 > 0 THEN 2 ELSE 1 END AS mate, is_rev, ref, base, {_DISTS} FROM bases), c AS (SELECT mate, is_rev, CASE WHEN d5 <= d3 THEN 5 ELSE 3 END AS end_, least(d5, d3) AS dist, ref, base, count(*) AS n FROM e GROUP BY ALL), "
    "f AS (SELECT *, n / sum(n) OVER (PARTITION BY mate, is_rev, end_, dist, ref) AS f FROM c) SELECT a.mate, a.is_rev, a.end_ AS \"end\", a.dist, a.ref, a.base, a.n, round(a.f, 6) AS share, CASE WHEN a.ref <> a.base AND coalesce(b.f, 0) < 1 THEN round((a.f - coalesce(b.f, 0)) / (1 - coalesce(b.f, 0)), 6) END AS damage "
    "FROM f a LEFT JOIN f b ON a.mate = b.mate AND a.is_rev = b.is_rev AND a.end_ = b.end_ AND a.dist = b.dist AND a.ref = b.base AND a.base = b.ref"
)
def transition_tables(s, d):
    mate = F.when(reads.has(reads.PAIRED), F.when(reads.has(reads.SECOND), 2).otherwise(1)).otherwise(0)
    return sites.transition_table(_distances(s, d).withColumn("mate", mate))


@query(
    f"WITH {sql.BASES}, c AS (SELECT off, count_if(ref = 1 AND base = 3) AS n13, count_if(ref = 3 AND base = 1) AS n31, count_if(ref = 1) AS n1, count_if(ref = 3) AS n3 FROM bases GROUP BY off), w AS (SELECT *, sum(n1) OVER (ORDER BY off DESC) AS s1, sum(n3) OVER (ORDER BY off DESC) AS s3 FROM c), "
    "k AS (SELECT greatest(15, coalesce(max(off) FILTER (s1 >= 500 AND s3 >= 500), 0)) AS cut FROM w), p AS (SELECT least(off, cut) AS off, count(*) AS n, sum(n13) AS n13, sum(n31) AS n31, sum(n1) AS n1, sum(n3) AS n3 FROM c, k GROUP BY ALL) "
    "SELECT CAST(off AS BIGINT) AS off, n, round(greatest(1e-9, (n13 / n1 - n31 / n3) / (1 - n31 / n3)), 9) AS psi FROM p WHERE n1 > 0 AND n3 > 0"
)
def damage_init(s, d):
    return sites.damage_init(views.bases(s, d), 500)


_RECAL = "CAST(greatest(1, floor(-10 * log10(1 / (1 + exp(-(0.1 + 0.9 * ln(pow(10.0, -qual / 10) / (1 - pow(10.0, -qual / 10))) + 0.01 * off)))) + 1e-9)) AS BIGINT)"


@query(f"WITH {sql.BASES}, q AS (SELECT rg, qual, {_RECAL} AS q2 FROM bases), b AS (SELECT 'raw' AS kind, rg, qual FROM q UNION ALL SELECT 'recalibrated', rg, q2 FROM q) SELECT kind, rg, qual, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT kind, 'all', qual, count(*) FROM b GROUP BY kind, qual")
def quality_histogram(s, d):
    rows = views.bases(s, d, "rg")
    again = rows.withColumn("qual", selection.recalibrated(F.col("qual"), F.col("off")))
    return sites.quality_histogram(rows).withColumn("kind", F.lit("raw")).unionByName(sites.quality_histogram(again).withColumn("kind", F.lit("recalibrated")))


_N1 = _HELD[: _HELD.index(", g0 AS")]


@query(
    f"WITH {_N1}, g AS (SELECT chrom, site, ref, count(*) AS depth, [{', '.join(f'sum(ln((l{a} + l{b}) / 2))' for a, b in GENOTYPES)}] AS g FROM n1 GROUP BY ALL) SELECT chrom, site, ref, depth, {', '.join(f'round(exp(g[{i + 1}] - list_max(g)), 6) AS g{i}' for i in range(10))} FROM g"
)
def damage_likelihood(s, d):
    rows = inference.damaged_likelihoods(_ended(s, d), with_models)
    return rows.select("chrom", "site", "ref", "depth", *(F.round(F.element_at("gl", i + 1), 6).alias(f"g{i}") for i in range(10)))


_W = [f"CASE WHEN ref = {b} THEN 0.999 ELSE 0.001 / 3 END" for b in range(4)]
_DS = f"{_N1.replace('SELECT chrom, site, ref, base, qual, rg, is_rev,', 'SELECT read_id, chrom, site, ref, base, qual, rg, is_rev,')}, scores AS (SELECT read_id, round(sum(ln(({' + '.join(f'l{b} * ({_W[b]})' for b in range(4))}) / ({' + '.join(f'e{b} * ({_W[b]})' for b in range(4))}))), 6) AS ds FROM n1 GROUP BY read_id)"


@query(f"WITH {_DS} SELECT read_id, ds FROM scores")
def pmds_score(s, d):
    return inference.damage_scores(_modelled(s, d))


@query(f"WITH {_DS} SELECT round(ds, 1) + 0.0 AS bin, count(*) AS n FROM scores GROUP BY ALL")
def pmds_histogram(s, d):
    return inference.damage_scores(_modelled(s, d)).groupBy((F.round("ds", 1) + 0.0).alias("bin")).agg(F.count("*").alias("n"))


# calls

_BEST = "CAST(list_position(post, list_max(post)) AS BIGINT)"
_GQ = f"least(999.0, round(-10 * log10(greatest(1e-300, list_sum(list_transform(range(1, 11), lambda i: CASE WHEN i = {_BEST} THEN 0 ELSE post[i] END)))), 3))"


@query(f"WITH {sql.posterior(sites.theta_prior(THETA))} SELECT chrom, site, {_BEST} - 1 AS genotype, round(list_max(post), 6) AS prob, {_GQ} AS gq FROM posts")
def call_bayes(s, d):
    return sites.call_bayes(sites.genotype_likelihoods(views.bases(s, d)), sites.theta_prior(THETA))


@query(
    f"WITH {sql.posterior(sites.theta_prior(THETA))} SELECT chrom, site, "
    + ", ".join(f"round({' + '.join(f'post[{i + 1}]' for i, g in enumerate(sql.GENOTYPES) if b in g)}, 6) AS p_{'acgt'[b]}" for b in range(4))
    + f", {_BEST} - 1 AS genotype, {_GQ} AS gq FROM posts"
)
def call_allele_presence(s, d):
    return sites.call_allele_presence(sites.genotype_likelihoods(views.bases(s, d)), sites.theta_prior(THETA))


@query(
    f"WITH {sql.LIKELIHOODS} SELECT chrom, site, array_to_string(list_transform(gl, lambda x: CAST(round(log10(x), 4) + 0.0 AS DECIMAL(12, 4))), ',') AS gl, array_to_string(list_transform(gl, lambda x: CAST(round(-10 * (round(log10(x), 4) + 0.0)) AS BIGINT)), ',') AS pl FROM sites"
)
def call_columns(s, d):
    return sites.call_columns(sites.genotype_likelihoods(views.bases(s, d)))


# populations


@query(
    f"WITH {sql.GL}, k AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'C,G' ELSE 'C' END AS alt FROM gl WHERE dp >= 2), l AS (SELECT chrom, pos FROM k GROUP BY ALL HAVING count(*) >= 3 AND 1 - count(*) / 12.0 <= 0.7 AND max(alt) NOT LIKE '%,%' AND least(sum(gt) / (2.0 * count(*)), 1 - sum(gt) / (2.0 * count(*))) >= 0.1) SELECT k.* FROM k JOIN l USING (chrom, pos)"
)
def locus_filter(s, d):
    rows = views.genotypes(s, d).withColumn("alt", F.expr("CASE WHEN pos % 3 = 0 THEN 'C,G' ELSE 'C' END"))
    return population.locus_filter(rows, 2, 3, 0.1, 0.7, 12)


@query(f"WITH {sql.GL}, q AS (SELECT *, list_sort([pl0, pl1, pl2])[2] AS gq FROM gl) SELECT chrom, pos, sample, gq, CASE WHEN dp >= 3 AND gq >= 10 THEN gt END AS gt FROM q")
def sample_call_filter(s, d):
    return population.call_filter(views.genotypes(s, d), 3, 10).select("chrom", "pos", "sample", "gq", "gt")


@query(
    f"WITH {sql.GL}, h AS (SELECT dp - ad AS ref_depth, ad AS alt_depth, least(CASE WHEN pl0 > 0 THEN pl0 ELSE 999 END, CASE WHEN pl2 > 0 THEN pl2 ELSE 999 END) AS gq FROM gl WHERE gt = 1) SELECT t.t AS threshold, ref_depth, alt_depth, count(*) AS n FROM h JOIN (VALUES (0), (10), (20)) t(t) ON gq >= t.t GROUP BY ALL"
)
def het_imbalance(s, d):
    return population.het_imbalance(views.genotypes(s, d), [0, 10, 20])


@query(f"WITH {sql.GL} SELECT DISTINCT ['chr1', '2', 'chrX'][CAST(chrom AS INT)] AS chrom, pos, {sql.LOCUS_REF} AS ref, {sql.LOCUS_ALT} AS alt FROM gl")
def to_posfile(s, d):
    """Places and alleles of the loci of a file of calls."""
    return _calls(s, d).select("chrom", "pos", "ref", "alt").distinct()


@query(
    f"WITH {sql.GL}, t AS (SELECT chrom, pos, CAST(sum(gt) AS BIGINT) AS alt, 2 * count(*) AS total FROM gl GROUP BY ALL), a AS (SELECT chrom, pos - 1 AS site, CASE WHEN least(alt, total - alt) <= 4 AND total >= 12 THEN CASE WHEN 2 * alt > total THEN 'C' ELSE 'A' END ELSE 'N' END AS l FROM t), "
    "grid AS (SELECT CAST(v.c AS BIGINT) AS chrom, r.range AS site FROM (VALUES (1), (2), (3)) v(c), range(0, 20000) r) SELECT grid.chrom, grid.site // 60 AS line, string_agg(coalesce(a.l, 'N'), '' ORDER BY grid.site) AS letters FROM grid LEFT JOIN a ON a.chrom = grid.chrom AND a.site = grid.site GROUP BY ALL"
)
def ancestral_fasta(s, d):
    calls = population.ancestral_alleles(views.genotypes(s, d), 4, 12).select("chrom", "pos", "ancestral", F.lit("A").alias("ref"), F.lit("C").alias("alt"))
    return population.ancestral_lines(calls, s.range(1, 4).withColumnRenamed("id", "chrom"), 20_000)


_POST = (
    f"WITH {sql.NORMAL}, grid AS (SELECT range AS i, (range + 0.5) / 101 AS f FROM range(0, 101)), "
    "l AS (SELECT chrom, pos, pop, i, any_value(-0.3 * ln(f * (1 - f))) + sum(ln(l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)) AS l FROM normal, grid GROUP BY ALL), "
    "m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY chrom, pos, pop)) AS w FROM l), post AS (SELECT *, w / sum(w) OVER (PARTITION BY chrom, pos, pop) AS p FROM m)"
)


@query(
    f"{_POST}, e AS (SELECT *, sum(p) OVER (PARTITION BY chrom, pos, pop ORDER BY i) AS c FROM post) SELECT chrom, pos, pop, round((arg_max(i, round(p, 12)) + 0.5) / 101, 6) AS map, "
    "round((count_if(c < 0.05) + 0.5) / 101, 6) AS low, round((count_if(c < 0.95) + 0.5) / 101, 6) AS high FROM e GROUP BY ALL"
)
def allele_freq_bayes(s, d):
    return models.allele_freq_bayes(models.frequency_posterior(views.genotypes(s, d), 101))


def _inbreeding() -> str:
    from helixmill.plans.models import _inbreeding as surface

    return f"WITH s AS ({surface(3)}) SELECT arg_max(f, ll) AS f, round(max(ll), 3) AS ll, round(2 * (max(ll) - max(ll) FILTER (f = 0)), 3) AS ratio FROM s"


@query(_inbreeding())
def inbreeding_estimate(s, d):
    return models.inbreeding_estimate(models.inbreeding_surface(views.genotypes(s, d)))


def _one(ploidy: str) -> str:
    return f"CASE WHEN {ploidy} THEN CASE gt WHEN 0 THEN 'A' WHEN 2 THEN 'C' END ELSE CASE gt WHEN 0 THEN 'AA' WHEN 1 THEN 'AC' ELSE 'CC' END END"


@query(
    f"WITH {sql.GL}, a AS (SELECT chrom, pos, sample, {_one('sample = 3')} AS call FROM gl WHERE dp <> 3), b AS (SELECT chrom, pos, sample, {_one('sample % 2 = 1')} AS call FROM (SELECT * REPLACE ((gt + pos) % 3 AS gt) FROM gl) WHERE dp <> 5) "
    "SELECT coalesce(a.call, '-') AS g1, coalesce(b.call, '-') AS g2, count(*) AS n FROM a FULL JOIN b ON a.chrom = b.chrom AND a.pos = b.pos AND a.sample = b.sample GROUP BY ALL"
)
def compare_calls(s, d):
    gl = views.genotypes(s, d)
    one, two = gl.where("dp <> 3").withColumn("call", F.expr(_one("sample = 3"))), gl.where("dp <> 5").withColumn("gt", F.expr("(gt + pos) % 3")).withColumn("call", F.expr(_one("sample % 2 = 1")))
    return population.compare_calls(one, two)


def _mixed(steps: int) -> str:
    text, before = f"WITH {sql.NORMAL}, p AS (SELECT *, CASE WHEN sample % 4 = 1 THEN 1 ELSE 2 END AS ploidy FROM normal), f0 AS (SELECT DISTINCT chrom, pos, pop, CAST(0.5 AS DOUBLE) AS f FROM p)", "f0"
    for t in range(1, steps + 1):
        two = "(l1 * 2 * f * (1 - f) + 2 * l2 * f * f) / (l0 * (1 - f) * (1 - f) + l1 * 2 * f * (1 - f) + l2 * f * f)"
        text += f", f{t} AS (SELECT chrom, pos, pop, sum(CASE ploidy WHEN 1 THEN l2 * f / (l0 * (1 - f) + l2 * f) ELSE {two} END) / sum(ploidy) AS f FROM p JOIN {before} USING (chrom, pos, pop) GROUP BY ALL)"
        before = f"f{t}"
    return text + f" SELECT chrom, pos, pop, CAST(sum(ploidy) AS BIGINT) AS n_alleles, round(any_value(f), 6) AS freq FROM p JOIN {before} USING (chrom, pos, pop) GROUP BY ALL"


@query(_mixed(3))
def allele_freq_mixed(s, d):
    return population.allele_freq_mixed(views.genotypes(s, d).withColumn("ploidy", F.expr("CASE WHEN sample % 4 = 1 THEN 1 ELSE 2 END")), 3)


_PAIRED = f"{sql.FILTERED}, k AS (SELECT *, sum(flag & 1) OVER (PARTITION BY name) AS m FROM filtered WHERE reason IS NULL)"


@query(
    f"WITH {_PAIRED} SELECT 'plain' AS kind, read_id, flag, clip_left FROM k WHERE flag & 1 = 0 OR m = 2 UNION ALL SELECT 'orphans, no clips', read_id, flag, 0 FROM k "
    "UNION ALL SELECT 'single', read_id, CAST(flag & ~235 AS INT), clip_left FROM k WHERE (flag & 1 = 0 OR m = 2) AND (flag & 1 = 0 OR flag & 64 > 0)"
)
def filter_pairs(s, d):
    rows = reads.read_filter(views.reads(s, d), mapq=(10, 50), soft_clip=0.3)
    kinds = {"plain": {}, "orphans, no clips": {"keep_orphans": True, "remove_clips": True}, "single": {"single": "first"}}
    out = None
    for kind, options in kinds.items():
        part = loci.consistent_pairs(rows, **options).select(F.lit(kind).alias("kind"), "read_id", "flag", F.col("clip_left").cast("long").alias("clip_left"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    f"WITH {sql.BASES}, {sql.REGIONS}, b AS (SELECT chrom, site, count(*) AS n FROM bases GROUP BY ALL), w AS (SELECT chrom, start, unnest(range(start, least(stop + 30, 50000))) AS site FROM (SELECT DISTINCT chrom, start, stop FROM (SELECT chrom, start, max(stop) AS stop FROM regions GROUP BY ALL))), "
    f"l AS (SELECT 'list' AS kind, chrom, start AS win, CAST(sum(n) AS BIGINT) AS n_bases, count(*) AS n_sites FROM w JOIN b USING (chrom, site) GROUP BY ALL) SELECT * FROM l UNION ALL SELECT 'tumbling', chrom, site // {WIN}, count(*), count(DISTINCT site) FROM bases WHERE site // {WIN} BETWEEN 2 AND 5 GROUP BY ALL"
)
def genome_windows(s, d):
    """Windows of one size, the first two skipped and four taken, and those of a list."""
    bases = views.bases(s, d)
    listed = views.regions(s, d).groupBy("chrom", "start").agg((F.max("stop") + 30).alias("stop")).withColumn("win", F.col("start"))
    return selection.bed_windows(bases, listed, views.GENOME).withColumn("kind", F.lit("list")).unionByName(selection.genome_windows(bases, WIN, 2, 4).withColumn("kind", F.lit("tumbling")))


@query(
    f"WITH {sql.LIKELIHOODS}, m AS (SELECT chrom, site, CAST(floor(sqrt(avg(mapq * mapq))) AS BIGINT) AS rms_mapq FROM bases GROUP BY ALL) SELECT chrom, site, depth, rms_mapq, {', '.join(f'CAST(least(32767, floor(-1000 * log10(gl[{i + 1}]) + 0.5)) AS BIGINT) AS q{i}' for i in range(10))} FROM sites JOIN m USING (chrom, site)"
)
def write_sites(s, d):
    path = files.scratch(s)
    files.write_sites(sites.genotype_likelihoods(views.bases(s, d, "mapq")), path)
    return files.read_sites(s, path)
