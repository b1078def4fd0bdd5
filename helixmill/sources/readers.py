"""Readers of the text files that users have: alignments, references, intervals, alleles, genotypes, counts, lists.

Each reads with Spark's own sources and splits lines by expressions; places become 0-based. Chromosomes and reads keep the
names that the files give them; ``chromosomes`` is the dictionary of a header, and ``numbered`` joins its numbers, by
which coordinates are ordered. A line that can't be read is left out, and ``rejected`` lists those of a file. The writers
make such files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixmill.operators.alignment import LETTERS, cigar_text, code, length, parsed_cigar
from helixmill.operators.binned import before_bins, in_bin, joined
from helixmill.operators.sized import few


def letter(base: Column) -> Column:
    return F.when(base.between(0, 3), F.substring(F.lit(LETTERS), (base + 1).cast("int"), F.lit(1))).otherwise("N")


def _tagged(name: str) -> Column:
    """The value of a field NAME:value of a header line."""
    return F.regexp_extract("value", rf"\t{name}:([^\t]*)", 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, or of all files of a folder and of those below it."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def numbered(rows: DataFrame, chroms: DataFrame, name: str = "chrom", number: str = "number") -> DataFrame:
    """rows with the number of their chromosome, null for one that the dictionary lacks."""
    return rows.join(few(chroms.select(F.col("chrom").alias(name), F.col("number").alias(number))), name, "left")


def write_alignments(reads: DataFrame, chroms: DataFrame, groups: DataFrame, path: str) -> None:
    """Alignment text: header lines of chromosomes (number, chrom, length) and groups (rg), then reads in order of place.

    reads: name, flag, chrom (null for none), pos, mapq and rg (null for none); and, where they are there, cigar (else len
    aligned bases), tlen, mate_chrom, mate_pos, seq and quality. The header is a file of its own that sorts first.
    """
    has = set(reads.columns)
    lines = chroms.select(F.lit(1).alias("_k"), F.col("number").alias("_n"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "chrom"), F.concat(F.lit("LN:"), "length")).alias("value"))
    lines = lines.unionByName(groups.select(F.lit(2).alias("_k"), F.lit(0).cast("long").alias("_n"), F.concat_ws("\t", F.lit("@RG"), F.concat(F.lit("ID:"), "rg"), F.lit("SM:one")).alias("value")))
    lines.coalesce(1).sortWithinPartitions("_k", "_n", "value").select("value").write.text(f"{path}/header")
    tag = F.when(F.col("rg").isNotNull(), F.concat(F.lit("RG:Z:"), "rg"))
    cigar = cigar_text() if "cigar" in has else F.concat("len", F.lit("M"))
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.coalesce("mate_chrom", F.lit("*"))) if "mate_chrom" in has else F.lit("*")
    own = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other)) if c in has else F.lit(other)
    after = F.coalesce((F.col("mate_pos") + 1).cast("string"), F.lit("0")) if "mate_pos" in has else F.lit("0")
    line = F.concat_ws("\t", "name", "flag", F.coalesce("chrom", F.lit("*")), F.coalesce(F.col("pos") + 1, F.lit(0)), "mapq", F.coalesce(cigar, F.lit("*")), mate, after, own("tlen", "0"), own("seq", "*"), own("quality", "*"), tag)
    rows = numbered(reads, chroms, number="_at")
    rows.repartitionByRange("_at", "pos").sortWithinPartitions(F.col("_at").asc_nulls_last(), "pos", "name").select(line.alias("value")).write.text(f"{path}/reads")


def _alignment_rows(spark: SparkSession, path: str, no_group: str | None = None) -> DataFrame:
    f = F.split("value", "\t")
    at = lambda k: F.get(f, F.lit(k - 1))
    star = lambda k, other="*": F.when(at(k) != other, at(k))
    group = F.regexp_extract("value", r"\tRG:Z:([^\t]+)", 1)
    rows = _lines(spark, path).where("NOT startswith(value, '@') AND value <> ''").select(
        F.col("value").alias("_line"), at(1).alias("name"), at(2).try_cast("int").alias("flag"), star(3).alias("chrom"), (at(4).try_cast("long") - 1).alias("pos"), at(5).try_cast("long").alias("mapq"),
        at(6).alias("_c"), parsed_cigar(at(6)).alias("cigar"), F.when(at(7) == "=", star(3)).otherwise(star(7)).alias("mate_chrom"), (at(8).try_cast("long") - 1).alias("mate_pos"), at(9).try_cast("long").alias("tlen"),
        star(10).alias("seq"), star(11).alias("quality"), F.coalesce(F.when(group != "", group), F.lit(no_group).cast("string")).alias("rg"), (F.size(f) >= 11).alias("_whole"),
    )
    ok = F.col("_whole") & F.col("flag").isNotNull() & F.col("pos").isNotNull() & F.col("mapq").isNotNull() & F.col("tlen").isNotNull() & ((F.col("_c") == "*") | F.col("cigar").isNotNull())
    return rows.withColumn("_ok", F.coalesce(ok, F.lit(False))).drop("_c", "_whole").withColumn("len", F.coalesce(length("M", "=", "X"), F.lit(0)))


def read_alignments(spark: SparkSession, path: str, no_group: str | None = None) -> DataFrame:
    """name, flag, chrom, pos, mapq, cigar, len (aligned bases), mate_chrom, mate_pos, tlen, seq, quality, rg of a file or folder.

    Names are text. What a line marks as missing is null; a read without a place has a null chrom, and one without a group
    null or no_group.
    """
    names = ["name", "flag", "chrom", "pos", "mapq", "cigar", "len", "mate_chrom", "mate_pos", "tlen", "seq", "quality", "rg"]
    return _alignment_rows(spark, path, no_group).where("_ok").select(*names)


def alignment_counts(reads: DataFrame) -> DataFrame:
    """How many reads there are, how many lack a group, and how many have no place."""
    return reads.agg(F.count("*").alias("n_reads"), F.count_if(F.col("rg").isNull()).alias("n_no_group"), F.count_if(F.col("chrom").isNull()).alias("n_unaligned"))


def read_groups(spark: SparkSession, path: str, catch_all: str | None = None) -> DataFrame:
    """rg and number of the header's read groups, in order, and of a group for reads without one, if it is named.

    path is that of the alignments or, to save reading them, of their header alone.
    """
    rows = _lines(spark, path).where("startswith(value, '@RG')").select(_tagged("ID").alias("rg")).distinct()
    rows = rows.select((F.row_number().over(Window.orderBy("rg")) - 1).cast("long").alias("number"), "rg")  # header lines are few
    return rows.unionByName(spark.range(1).select(F.lit(rows.count()).cast("long").alias("number"), F.lit(catch_all).alias("rg"))) if catch_all else rows


def chromosomes(spark: SparkSession, path: str, use: list[str] | None = None, ploidy: dict[str, int] | None = None) -> DataFrame:
    """number (the place in the header, which orders coordinates), chrom, length, ploidy (2 where it is not given) and in_use.

    path as in ``read_groups``. Of a name given again the first line counts.
    """
    rows = _lines(spark, path).where("startswith(value, '@SQ')").select(_tagged("SN").alias("chrom"), _tagged("LN").try_cast("long").alias("length"), F.monotonically_increasing_id().alias("_i"))
    rows = rows.groupBy("chrom").agg(F.min_by("length", "_i").alias("length"), F.min("_i").alias("_i"))
    rows = rows.withColumn("number", (F.row_number().over(Window.orderBy("_i")) - 1).cast("long")).drop("_i")  # header lines are few
    of = F.lit(2)
    for c, n in (ploidy or {}).items():
        of = F.when(F.col("chrom") == c, n).otherwise(of)
    return rows.select("number", "chrom", "length", of.alias("ploidy"), (F.col("chrom").isin(use) if use is not None else F.lit(True)).alias("in_use"))


def write_fasta(reference: DataFrame, path: str, width: int = 60) -> None:
    """reference: chrom, site, ref. Places without a base, before the last one of a chromosome, are N. A chromosome is in one file."""
    rows = reference.groupBy("chrom", F.floor(F.col("site") / width).cast("long").alias("line")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("site") % width, letter(F.col("ref"))))).alias("_b"))
    last = rows.groupBy("chrom").agg(F.max("line").alias("_last"))
    every = last.select("chrom", F.explode(F.sequence(F.lit(-1).cast("long"), "_last")).alias("line"), "_last")  # -1: the header
    rows = every.join(rows, ["chrom", "line"], "left")
    size = F.when(F.col("line") < F.col("_last"), width).otherwise(F.array_max(F.map_keys("_b")) + 1)
    bases = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), size.cast("long") - 1), lambda i: F.coalesce(F.element_at("_b", i), F.lit("N"))), "")
    value = F.when(F.col("line") < 0, F.concat(F.lit(">"), F.col("chrom"), F.lit(" made here"))).otherwise(F.coalesce(bases, F.lit("N" * width)))
    rows.withColumn("value", value).repartition("chrom").sortWithinPartitions("chrom", "line").select("value").write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """chrom (the first word of the header), site and ref of every base of every sequence, N as 4.

    A line's place is the running length since its header. It is summed within a split of a file; a row for each split
    carries on the length and the header from the splits before.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_bin"), F.monotonically_increasing_id().alias("_id"))
    head = F.startswith("value", F.lit(">"))
    rows = rows.withColumns({"_n": F.when(head, 0).otherwise(F.length(F.trim("value"))).cast("long"), "_name": F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1))})
    w = in_bin("_file").orderBy("_id")
    rows = rows.withColumn("_at", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mark = F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("name"), F.col("_at").alias("at")))
    splits = rows.groupBy("_file", "_bin").agg(F.sum("_n").alias("_n"), F.max_by(mark, F.when(mark.isNotNull(), F.col("_id"))).alias("_mark"))
    total = F.coalesce(F.sum("_n").over(before_bins("_file")), F.lit(0))
    splits = splits.withColumn("_before", total).withColumn("_mark", F.when(F.col("_mark").isNotNull(), F.struct(F.col("_mark.name").alias("name"), (F.col("_mark.at") + F.col("_before")).alias("at"))))
    carry = splits.select("_file", "_bin", "_before", F.last("_mark", ignorenulls=True).over(before_bins("_file")).alias("_carry"))
    rows = joined(rows.withColumn("_own", F.last(mark, ignorenulls=True).over(w)), carry, "_file")
    start = F.col("_before") + F.col("_at") - F.coalesce(F.col("_own.at") + F.col("_before"), F.col("_carry.at"))
    lines = rows.where(~head).select(F.coalesce("_own.name", "_carry.name").alias("chrom"), start.alias("_start"), F.posexplode(F.split(F.trim("value"), "")))
    return lines.where("col <> ''").select("chrom", (F.col("_start") + F.col("pos")).alias("site"), code(F.col("col")).alias("ref"))


def write_bed(regions: DataFrame, path: str) -> None:
    regions.select("chrom", "start", "stop", *[c for c in regions.columns if c == "info"]).write.csv(path, sep="\t")


def _bed_rows(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+", 4)
    rows = _lines(spark, path).where("NOT value RLIKE '^(#|track|browser|\\\\s*$)'").select(F.col("value").alias("_line"), f[0].alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("stop"), F.get(f, F.lit(3)).alias("info"))
    return rows.withColumn("_ok", F.coalesce(F.col("start").isNotNull() & (F.col("start") >= 0) & (F.col("stop") >= F.col("start")), F.lit(False)))


def read_bed(spark: SparkSession, path: str, info: bool = False) -> DataFrame:
    """chrom, start, stop, and info if asked for; lines of comments, tracks and browsers are skipped."""
    return _bed_rows(spark, path).where("_ok").select("chrom", "start", "stop", *(["info"] if info else []))


def write_alleles(alleles: DataFrame, path: str) -> None:
    """alleles: chrom, site, known_ref, known_alt; an alternative of N is written as a point."""
    alt = F.when(F.col("known_alt") < 4, letter(F.col("known_alt"))).otherwise(".")
    alleles.select(F.col("chrom").alias("Chr"), (F.col("site") + 1).alias("Pos"), letter(F.col("known_ref")).alias("Ref"), alt.alias("Alt")).write.csv(path, sep="\t", header=True)


def _table_rows(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """The names of a header line, which each file of a folder may repeat, and _line and _f, the fields, of the others."""
    lines = _lines(spark, path).where("trim(value) <> '' AND NOT startswith(value, '#')").select(F.col("value").alias("_line"), F.split(F.trim("value"), r"\s+").alias("_f"))
    head = F.lower(F.col("_f")[0]).isin("chr", "chrom", "chromosome") & F.lower(F.get("_f", F.lit(1))).isin("pos", "position")
    first = lines.where(head).first()  # one line
    return list(first["_f"]) if first else [], lines.where(~head)


def _allele_rows(spark: SparkSession, path: str) -> DataFrame:
    names, rows = _table_rows(spark, path)
    place = {n.lower(): k for k, n in enumerate(names)}
    one, two = next((place[n] for n in ("ref", "allele1") if n in place), None), next((place[n] for n in ("alt", "allele2") if n in place), None)
    if one is None:
        raise ValueError(f"no column Ref or Allele1 in {names}")
    at = lambda k: F.get("_f", F.lit(k)) if k is not None else F.lit(None).cast("string")
    rows = rows.select("_line", at(0).alias("chrom"), (at(1).try_cast("long") - 1).alias("site"), code(at(one)).alias("known_ref"), F.coalesce(code(at(two)), F.lit(4).cast("long")).alias("known_alt"), at(one).alias("_r"))
    return rows.withColumn("_ok", F.coalesce((F.col("site") >= 0) & F.col("_r").isNotNull(), F.lit(False)))


def read_alleles(spark: SparkSession, path: str, kind: str = "both") -> DataFrame:
    """chrom, site, known_ref, known_alt (N where there is one allele): of sites with one allele (mono), two (poly), or both.

    The header names Chr and Pos first, then Ref and Alt or Allele1 and Allele2, of which the second may be left out.
    """
    rows = _allele_rows(spark, path).where("_ok").select("chrom", "site", "known_ref", "known_alt")
    one = (F.col("known_alt") == 4) | (F.col("known_alt") == F.col("known_ref"))
    return rows.where({"mono": one, "poly": ~one, "both": F.lit(True)}[kind])


def write_vcf(lines: DataFrame, samples: list[str], path: str) -> None:
    """Body lines (chrom, pos, line) in order of place below a header, which is a file of its own."""
    head = ["##fileformat=VCFv4.2", *(f'##FORMAT=<ID={i},Number={n},Type={t},Description="{x}">' for i, n, t, x in (("GT", "1", "String", "Genotype"), ("DP", "1", "Integer", "Depth"), ("GQ", "1", "Integer", "Quality"), ("PL", "G", "Integer", "Likelihoods")))]
    head.append("\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]))
    lines.sparkSession.createDataFrame([("\n".join(head),)], "value string").write.text(f"{path}/header")
    lines.repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("line").write.text(f"{path}/body")


def _vcf_rows(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    rows = _lines(spark, path).where("NOT startswith(value, '#') AND value <> ''").select(F.col("value").alias("_line"), f.alias("_f"), F.get(f, F.lit(1)).try_cast("long").alias("pos"))
    return rows.withColumn("_ok", F.coalesce(F.col("pos").isNotNull() & (F.size("_f") >= 8), F.lit(False)))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    names = _lines(spark, path).where("startswith(value, '#CHROM')").first()  # one line; it names the samples
    return names["value"].split("\t")[9:] if names else []


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """A row for each locus and sample that has a call or likelihoods: chrom, pos, ref, alt, sample, ploidy, gt, dp, gq, ad, pl0 to pl2.

    Fields are found by their place in FORMAT. gt counts the alternative alleles, null if it is missing; PL is taken from
    GL where only that is there. A haploid cell, with one allele or two likelihoods, has ploidy 1, and its likelihoods are pl0
    and pl2. Sites with more than two alleles are left out.
    """
    samples = F.array(*map(F.lit, vcf_samples(spark, path)))
    rows = _vcf_rows(spark, path).where(F.col("_ok") & ~F.col("_f")[4].contains(",") & (F.size("_f") > 9))
    rows = rows.select(F.col("_f")[0].alias("chrom"), "pos", F.col("_f")[3].alias("ref"), F.col("_f")[4].alias("alt"), F.split(F.col("_f")[8], ":").alias("_k"), F.posexplode(F.expr("slice(_f, 10, size(_f))")).alias("_s", "_v"))
    value = lambda k: F.get(F.split("_v", ":"), (F.array_position("_k", k) - 1).cast("int"))  # noqa: E731  null beyond the cell's own fields
    field = lambda k: F.when((F.array_position("_k", k) > 0) & ~value(k).isin(".", ""), value(k))
    numbers = lambda k, kind: F.transform(F.split(field(k), ","), lambda x: x.try_cast(kind))
    alleles = F.split(field("GT"), r"[/|]")
    gt = F.when(~F.array_contains(alleles, "."), F.aggregate(alleles, F.lit(0), lambda a, x: a + x.try_cast("int")))
    gl = F.transform(numbers("GL", "double"), lambda x: F.round(-10 * x).cast("long"))
    rows = rows.withColumn("_pl", F.coalesce(numbers("PL", "bigint"), gl))
    ploidy = F.when(alleles.isNotNull(), F.size(alleles)).when(F.size("_pl") == 2, 1).otherwise(2)
    rows = rows.select("chrom", "pos", "ref", "alt", F.get(samples, F.col("_s")).alias("sample"), ploidy.alias("ploidy"), gt.alias("gt"), field("DP").try_cast("long").alias("dp"), field("GQ").try_cast("long").alias("gq"), numbers("AD", "bigint").alias("ad"), "_pl")
    two = F.size("_pl") == 2
    pl = [F.get("_pl", F.lit(0)), F.when(~two, F.get("_pl", F.lit(1))), F.when(two, F.get("_pl", F.lit(1))).otherwise(F.get("_pl", F.lit(2)))]
    return rows.select("*", *(x.alias(f"pl{k}") for k, x in enumerate(pl))).drop("_pl").where("gt IS NOT NULL OR pl0 IS NOT NULL")


def read_samples(spark: SparkSession, path: str, population: str = "all") -> DataFrame:
    """sample, pop and place in the file, from lines of a sample and its population, which may be left out."""
    f = F.split("value", r"\s+")
    rows = spark.read.text(path).where("value <> ''").select(f[0].alias("sample"), F.coalesce(F.get(f, F.lit(1)), F.lit(population)).alias("pop"), F.monotonically_increasing_id().alias("_i"))
    return rows.select("sample", "pop", (F.row_number().over(Window.orderBy("_i")) - 1).cast("long").alias("place"))  # a line for each sample


def _count_rows(spark: SparkSession, path: str) -> DataFrame:
    names, rows = _table_rows(spark, path)
    pops = [(k, n) for k, n in enumerate(names) if k > 1 and n.lower() not in ("ref", "alt")]
    cell = lambda k, i: F.get(F.split(F.get("_f", F.lit(k)), "/"), F.lit(i)).try_cast("long")
    cells = F.array(*(F.struct(F.lit(n).alias("pop"), cell(k, 0).alias("n_minor"), cell(k, 1).alias("n_total")) for k, n in pops))
    rows = rows.select("_line", F.col("_f")[0].alias("chrom"), F.get("_f", F.lit(1)).try_cast("long").alias("pos"), cells.alias("_cells"))
    return rows.withColumn("_ok", F.col("pos").isNotNull() & ~F.exists("_cells", lambda c: c["n_minor"].isNull() | c["n_total"].isNull()))


def read_count_table(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, pop, n_minor, n_total from a table of minor/total cells with a column for each population; 0/0 is missing."""
    return _count_rows(spark, path).where("_ok").select("chrom", "pos", F.inline("_cells")).where("n_total > 0")


_KINDS = {"alignments": _alignment_rows, "bed": _bed_rows, "alleles": _allele_rows, "vcf": _vcf_rows, "counts": _count_rows}


def rejected(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """line: the lines of such a file that its reader leaves out, as they can't be read."""
    return _KINDS[kind](spark, path).where("NOT _ok").select(F.col("_line").alias("line"))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """name: the first word of each line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("name")).where("name <> ''").distinct()


def read_phenotype(spark: SparkSession, path: str, column: str | None = None) -> DataFrame:
    """sample and trait: the named column, or the first after that of the sample; what is no number is left out."""
    rows = spark.read.csv(path, sep="\t", header=True)
    column = column or rows.columns[1]
    if column not in rows.columns[1:]:
        raise ValueError(f"no column {column} in {rows.columns}")
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("sample"), F.col(f"`{column}`").try_cast("double").alias("trait")).where("trait IS NOT NULL")
