"""Queries that write the test tables as the text files users have and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from helixmill.operators import alignment, population
from helixmill.operators.models import to_vcf
from helixmill.plans import sql
from helixmill.plans.models import mixed
from helixmill.plans.registry import query
from helixmill.sources import files, readers, views

SAMPLES = [f"s{k}" for k in range(12)]


NAMES = ("chr1", "2", "chrX")
_NAME = "['chr1', '2', 'chrX'][CAST({} AS INT)]"
#: The length of a chromosome: as far as its reads reach.
_REACH = "SELECT chrom, max(pos + len) AS length FROM reads GROUP BY chrom"


def named(chrom="chrom"):
    """The name in files of a chromosome's number; some names are no number."""
    return F.element_at(F.array(*map(F.lit, NAMES)), F.col(chrom).cast("int"))


def _alignments(s, d, whole=False):
    """The reads as text; every eleventh name has no group and every seventh no place. whole: with CIGARs, sequences and mates."""
    rows = views.alignments(s, d) if whole else views.reads(s, d)
    chroms = views.reads(s, d).groupBy("chrom").agg(F.max(F.expr("pos + len")).alias("length")).select((F.col("chrom") - 1).alias("number"), named().alias("chrom"), "length")
    rows = rows.withColumns({"rg": F.when(F.col("name") % 11 > 0, F.col("rg")), "chrom": F.when(F.col("name") % 7 > 0, named()), "name": F.concat(F.lit("SRR1."), "name")})
    rows = rows.withColumn("pos", F.when(F.col("chrom").isNotNull(), F.col("pos")))
    if whole:
        rows = rows.withColumns({"mate_chrom": F.when(F.col("flag") % 2 > 0, F.col("chrom")), "mate_pos": F.when(F.col("flag") % 2 > 0, F.col("pos") + 7)})
    path = files.scratch(s)
    readers.write_alignments(rows, chroms, views.reads(s, d).select("rg").distinct(), path)
    return path


_ODD = f"{sql.READS}, odd AS (SELECT 'SRR1.' || name AS name, flag, mapq, len, tlen, CASE WHEN name % 11 > 0 THEN rg END AS rg, CASE WHEN name % 7 > 0 THEN {_NAME.format('chrom')} END AS chrom, CASE WHEN name % 7 > 0 THEN pos ELSE -1 END AS pos FROM reads)"


@query(f"WITH {_ODD} SELECT name, flag, chrom, pos, mapq, len, tlen, coalesce(rg, 'none') AS rg FROM odd")
def scan_reads(s, d):
    return readers.read_alignments(s, _alignments(s, d), "none").select("name", "flag", "chrom", "pos", "mapq", "len", "tlen", "rg")


@query(f"WITH {_ODD} SELECT count(*) AS n_reads, count_if(rg IS NULL) AS n_no_group, count_if(chrom IS NULL) AS n_unaligned FROM odd")
def scan_read_counts(s, d):
    return readers.alignment_counts(readers.read_alignments(s, _alignments(s, d)))


@query(f"WITH {sql.READS}, g AS (SELECT DISTINCT rg FROM reads) SELECT row_number() OVER (ORDER BY rg) - 1 AS number, rg FROM g UNION ALL SELECT count(*), 'none' FROM g")
def scan_read_groups(s, d):
    return readers.read_groups(s, _alignments(s, d), "none")


@query(f"WITH {sql.READS}, c AS ({_REACH}) SELECT row_number() OVER (ORDER BY chrom) - 1 AS number, {_NAME.format('chrom')} AS chrom, length, CASE chrom WHEN 3 THEN 1 ELSE 2 END AS ploidy, chrom <> 2 AS in_use FROM c")
def scan_chromosomes(s, d):
    return readers.chromosomes(s, _alignments(s, d), ["chr1", "chrX"], {"chrX": 1})


@query(
    f"WITH {sql.ALIGNED}, s AS (SELECT *, CASE WHEN name % 7 > 0 THEN {_NAME.format('chrom')} END AS c FROM aligned), "
    "t AS (SELECT *, CASE WHEN k % 11 = 0 THEN '3H' ELSE '' END || CASE WHEN clip_left > 0 THEN clip_left || 'S' ELSE '' END || m1 || 'M' || CASE WHEN ins > 0 THEN ins || 'I' ELSE '' END || CASE WHEN del > 0 THEN del || 'D' ELSE '' END || CASE WHEN skip > 0 THEN skip || 'N' ELSE '' END || m2 || '=' || CASE WHEN clip_right > 0 THEN clip_right || 'S' ELSE '' END AS cigar, "
    "[CASE WHEN (k + i) % 53 = 0 THEN 'N' ELSE substr('ACGT', CAST((k * 31 + i * 17 + i * i + chrom) % 4 + 1 AS INT), 1) END for i in range(read_length)] AS seq, [chr(CAST(45 + (k * 7 + i * 3) % 30 AS INT)) for i in range(read_length)] AS quality FROM s) "
    "SELECT 'SRR1.' || name AS name, flag, c AS chrom, CASE WHEN c IS NULL THEN -1 ELSE pos END AS pos, cigar, array_to_string(seq, '') AS seq, array_to_string(quality, '') AS quality, CASE WHEN is_rev = 1 THEN -tlen ELSE tlen END AS tlen, CASE WHEN flag % 2 > 0 THEN c END AS mate_chrom, CASE WHEN flag % 2 > 0 AND c IS NOT NULL THEN pos + 7 ELSE -1 END AS mate_pos, CASE WHEN name % 11 > 0 THEN rg END AS rg FROM t"
)
def write_reads(s, d):
    """Whole reads through text: CIGARs, sequences, qualities and mates."""
    rows = readers.read_alignments(s, _alignments(s, d, True)).withColumn("cigar", alignment.cigar_text())
    return rows.select("name", "flag", "chrom", "pos", "cigar", "seq", "quality", "tlen", "mate_chrom", "mate_pos", "rg")


@query(
    f"WITH {sql.BASES}, r AS (SELECT DISTINCT chrom, site, ref FROM bases WHERE site % 7 > 0), m AS (SELECT chrom, max(site) AS last FROM r GROUP BY chrom), g AS (SELECT chrom, unnest(range(0, last + 1)) AS site FROM m) "
    f"SELECT {_NAME.format('g.chrom')} AS chrom, g.site, coalesce(r.ref, 4) AS ref FROM g LEFT JOIN r ON g.chrom = r.chrom AND g.site = r.site"
)
def scan_reference(s, d):
    path = files.scratch(s)
    readers.write_fasta(views.bases(s, d).select("chrom", "site", "ref").distinct().where("site % 7 > 0").withColumn("chrom", named()), path)
    return readers.read_fasta(s, path)


@query(f"WITH {sql.REGIONS} SELECT {_NAME.format('chrom')} AS chrom, start, stop, 'order ' || start AS info FROM regions")
def scan_bed(s, d):
    path = files.scratch(s)
    readers.write_bed(views.regions(s, d).withColumns({"info": F.concat(F.lit("order "), "start"), "chrom": named()}), path)
    return readers.read_bed(s, path, True)


@query(f"WITH {sql.ALLELES}, a AS (SELECT * REPLACE ({_NAME.format('chrom')} AS chrom), site % 3 = 0 AS one FROM alleles) SELECT 'mono' AS kind, chrom, site, known_ref, 4 AS known_alt FROM a WHERE one UNION ALL SELECT 'poly', chrom, site, known_ref, known_alt FROM a WHERE NOT one AND known_alt <> known_ref")
def scan_alleles(s, d):
    path = files.scratch(s)
    rows = views.alleles(s, d).withColumns({"known_alt": F.when(F.col("site") % 3 == 0, 4).otherwise(F.col("known_alt")), "chrom": named()}).where("known_alt <> known_ref")
    readers.write_alleles(rows, path)
    return readers.read_alleles(s, path, "mono").withColumn("kind", F.lit("mono")).unionByName(readers.read_alleles(s, path, "poly").withColumn("kind", F.lit("poly")))


def _calls(s, d):
    path = files.scratch(s)
    readers.write_vcf(to_vcf(mixed(s, d).withColumn("chrom", named()), len(SAMPLES)), SAMPLES, path)
    return readers.read_vcf(s, path)


@query(
    f"WITH {sql.GL}, t AS (SELECT *, sample % 4 = 3 AS one FROM gl) SELECT {_NAME.format('chrom')} AS chrom, pos, {sql.LOCUS_REF} AS ref, {sql.LOCUS_ALT} AS alt, 's' || sample AS sample, CASE WHEN one THEN 1 ELSE 2 END AS ploidy, CASE WHEN one THEN gt // 2 ELSE gt END AS gt, dp, pl0, CASE WHEN NOT one THEN pl1 END AS pl1, pl2 FROM t"
)
def scan_vcf(s, d):
    return _calls(s, d).drop("gq", "ad")


@query(f"WITH {sql.GL}, x AS (SELECT DISTINCT sample, pop FROM gl) SELECT 's' || sample AS sample, CASE WHEN sample < 10 THEN 'p' || pop ELSE 'all' END AS pop, sample AS place FROM x")
def scan_samples(s, d):
    path = files.scratch(s)
    rows = views.genotypes(s, d).select("sample", "pop").distinct().orderBy("sample").coalesce(1)
    rows.select(F.concat_ws("\t", F.concat(F.lit("s"), "sample"), F.when(F.col("sample") < 10, F.concat(F.lit("p"), "pop"))).alias("value")).write.text(path)
    return readers.read_samples(s, path)


@query(f"WITH {sql.GL} SELECT ['chr1', '2', 'chrX'][CAST(chrom AS INT)] AS chrom, pos, 'pop' || pop AS pop, CAST(sum(gt) AS BIGINT) AS n_minor, 2 * count(*) AS n_total FROM gl GROUP BY ALL")
def scan_counts(s, d):
    path = files.scratch(s)
    cells = population.f_table(views.genotypes(s, d), [0, 1, 2])
    cells.select(named().alias("chr"), "pos", "pop0", "pop1", "pop2").write.csv(path, sep="\t", header=True)
    return readers.read_count_table(s, path)


def _blacklist(s, d):
    path = files.scratch(s)
    views.load(s, d, "orders").where("o_custkey % 7 = 0").select(F.concat("o_orderkey", F.lit(" listed")).alias("value")).write.text(path)
    return readers.read_blacklist(s, path)


@query("SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS name FROM orders WHERE o_custkey % 7 = 0")
def scan_blacklist(s, d):
    return _blacklist(s, d)


@query(f"WITH {sql.GL}, x AS (SELECT DISTINCT sample FROM gl) SELECT 's' || sample AS sample, CAST((sample * 7) % 5 AS DOUBLE) AS trait FROM x WHERE sample <> 4")
def scan_phenotype(s, d):
    path = files.scratch(s)
    rows = views.genotypes(s, d).select("sample").distinct()
    trait = F.when(F.col("sample") == 4, "NA").otherwise((F.col("sample") * 7 % 5).cast("string"))
    rows.select(F.concat(F.lit("s"), "sample").alias("sample"), F.lit("x").alias("site"), trait.alias("height")).write.csv(path, sep="\t", header=True)
    return readers.read_phenotype(s, path, "height")
