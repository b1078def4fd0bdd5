"""Reads as aligned, and ordinary text files, on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from helixmill.operators import alignment, population, reads
from helixmill.sources import files, readers

READ = "read_id long, chrom long, pos long, flag int, tlen long, text string, seq string, quality string"


def made(spark, *rows):
    return spark.createDataFrame(rows, READ).withColumn("cigar", alignment.parsed_cigar("text")).drop("text")


def walked_by_hand(pos, cigar):
    """(kind, place in the read, site) of each base, operation by operation."""
    out, at, ref = [], 0, pos
    for op, n in cigar:
        for _ in range(n):
            if op in "M=X":
                out.append(("M", at, ref))
            elif op in "IS":
                out.append((op, at, None))
            at += op in "M=XIS"
            ref += op in "M=XDN"
    return out


CIGARS = ["5M", "2S3M", "3M2S", "1H2S2M1I3M2D2M3N1M1S2H", "2=1X2I1D1=", "3I2M", "2M5N2M", "1M1I1D1M", "4S", "2M2P1M", "3M0I2M"]


@pytest.mark.parametrize("flag", [0, 16, 3, 19])
def test_bases_stand_where_the_cigar_puts_them(spark, flag):
    import re

    rows, want = [], []
    for k, text in enumerate(CIGARS):
        ops = [(o, int(n)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", text)]
        by_hand = walked_by_hand(100, ops)
        seq = "".join("ACGTN"[(3 * i + k) % 5] for i in range(len(by_hand)))
        rows.append((k, 1, 100, flag, 40, text, seq, "".join(chr(33 + i) for i in range(len(seq)))))
        left, seen = 0, True
        for o, n in ops:
            left += n if o == "S" and seen else 0
            seen = seen and o in "SHP"
        sequenced = sum(n for o, n in ops if o in "M=XI")
        frag = max(0, 40 + sum(n for o, n in ops if o == "I") - sum(n for o, n in ops if o == "D")) if flag & 2 else sequenced
        for kind, at, site in by_hand:
            off, code = at - left, ["ACGT".find(c) if c in "ACGT" else 4 for c in seq]
            if flag & 16:
                d5, d3 = sequenced - 1 - off, off + frag - sequenced if flag & 2 else off
                prev = 3 - code[at + 1] if at + 1 < len(seq) and code[at + 1] < 4 else 4
            else:
                d5, d3 = off, (frag if flag & 2 else sequenced) - 1 - off
                prev = code[at - 1] if at else 4
            clip = kind == "S"
            want.append((k, kind, at, site, None if clip else off, code[at], at, None if clip else d5, None if clip else d3, prev))
    got = alignment.bases(made(spark, *rows), "MIS", with_context=True).select("read_id", "kind", "at", "site", "off", "base", "qual", "d5", "d3", "prev")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plain = alignment.bases(made(spark, *rows)).select("read_id", "at", "site").collect()
    assert sorted(map(tuple, plain)) == sorted((w[0], w[2], w[3]) for w in want if w[1] == "M")


def test_reads_without_bases_are_named(spark):
    rows = [(1, 1, 5, 0, 0, "3M", "ACG", "III"), (2, 1, 5, 0, 0, "*", "ACG", "III"), (3, 1, 5, 0, 0, "3M", "AC", "III"), (4, 1, 5, 0, 0, "3M", "ACG", "II"), (5, 1, 5, 0, 0, "3M", "*", "*"), (6, 1, 5, 0, 0, "3Z", "ACG", "III"), (7, 1, 5, 0, 0, None, None, None), (8, 1, 5, 0, 0, "3M1", "ACG", "III")]
    at = made(spark, *rows)
    assert {r.read_id: r.reason for r in alignment.malformed(at).collect()} == {2: "no cigar", 3: "sequence length", 4: "quality length", 5: "no sequence", 6: "no cigar", 7: "no cigar", 8: "no cigar"}
    assert {r.read_id for r in alignment.bases(at).collect()} == {1}
    assert alignment.bases(at.limit(0)).count() == 0 and alignment.malformed(at.limit(0)).count() == 0
    assert [r.t for r in at.where("read_id = 1").select(alignment.cigar_text().alias("t")).collect()] == ["3M"]


def test_lengths_and_fragments(spark):
    rows = [(1, 1, 200, 2 | 64, -150, "50M", "", ""), (2, 1, 100, 2 | 128 | 16, 150, "5S40M2I3D5N8M1S", "", ""), (3, 1, 1, 0, 900, "2S10M3I", "", ""), (4, 1, 1, 2, 1, "4M9D", "", "")]
    got = alignment.with_lengths(made(spark, *rows)).select("read_id", alignment.fragment().alias("f"), "read_length", "mapped", "sequenced").collect()
    assert sorted(map(tuple, got)) == [(1, 150, 50, 50, 50), (2, 149, 56, 56, 50), (3, 13, 15, 10, 13), (4, 0, 4, 13, 4)]


def test_lengths_that_filters_look_at(spark):
    rows = [(1, 0, 20, 5, 5, 0, 0, 0, 30, 30), (2, 0, 20, 0, 0, 0, 0, 0, 20, 20), (3, 0, 20, 0, 0, 6, 0, 0, 26, 26), (4, 0, 30, 0, 0, 0, 400, 100, 30, 30), (5, 2, 30, 0, 0, 0, 0, 0, -29, 90), (6, 2, 30, 0, 0, 0, 0, 0, -30, 90)]
    at = spark.createDataFrame(rows, "read_id long, flag int, len long, clip_left long, clip_right long, inserted long, deleted long, skipped long, tlen long, frag long")
    got = {r.read_id: r.reason for r in reads.read_filter(at, length=(25, 60), longer_than_fragment=True).collect()}
    assert got == {1: None, 2: "ReadLength", 3: None, 4: "MappedLength", 5: "LongerThanFragment", 6: None}
    assert {r.read_id: r.reason for r in reads.read_filter(at.drop("inserted", "deleted", "skipped"), length=(25, 60)).collect()}[3] == "ReadLength"


def test_neighbours_of_equal_fragments(spark):
    rows = [(1, "a", 1, 10, 0, 150), (2, "a", 1, 10, 16, 150), (3, "a", 1, 10, 0, 300), (4, "b", 1, 10, 0, 300), (5, "a", 1, 11, 0, 300)]
    at = spark.createDataFrame(rows, "read_id long, rg string, chrom long, pos long, flag int, frag long").withColumn("len", F.lit(40))
    got = reads.potential_duplicates(at).select("previous_id", "read_id", "previous_rev", "is_rev", "frag").collect()
    assert sorted(map(tuple, got)) == [(1, 2, 0, 1, 150)]


def text(spark, *lines):
    path = files.scratch(spark)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


def test_an_ordinary_alignment_file(spark):
    path = text(
        spark, "@HD\tVN:1.6", "@SQ\tSN:chrX\tLN:500", "@SQ\tSN:1\tLN:900", "@SQ\tSN:chrX\tLN:7", "@RG\tID:b\tSM:s", "@RG\tID:a",
        "SRR1.17\t99\tchrX\t10\t60\t2S3M\t=\t40\t33\tACGTN\tIIIII\tNM:i:0\tRG:Z:b", "r/2\t147\t1\t1\t0\t*\tchrX\t9\t-33\t*\t*", "lost\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII",
        "short\t0\t1", "odd\tx\t1\t1\t0\t3M\t*\t0\t0\t*\t*", "bad\t0\t1\t1\t0\t3Q\t*\t0\t0\t*\t*",
    )
    got = readers.read_alignments(spark, path, "none").withColumn("cigar", alignment.cigar_text()).select("name", "flag", "chrom", "pos", "mapq", "cigar", "len", "mate_chrom", "mate_pos", "tlen", "seq", "quality", "rg")
    assert sorted(map(tuple, got.collect())) == [
        ("SRR1.17", 99, "chrX", 9, 60, "2S3M", 3, "chrX", 39, 33, "ACGTN", "IIIII", "b"), ("lost", 4, None, -1, 0, None, 0, None, -1, 0, "AC", "II", "none"), ("r/2", 147, "1", 0, 0, None, 0, "chrX", 8, -33, None, None, "none"),
    ]
    assert sorted(r.line.split("\t")[0] for r in readers.rejected(spark, path, "alignments").collect()) == ["bad", "odd", "short"]
    chroms = readers.chromosomes(spark, path, ["1"], {"chrX": 1})
    assert sorted(map(tuple, chroms.collect())) == [(0, "chrX", 500, 1, False), (1, "1", 900, 2, True)]
    assert {r.name: r.number for r in readers.numbered(got, chroms).collect()} == {"SRR1.17": 0, "r/2": 1, "lost": None}
    assert sorted(map(tuple, readers.read_groups(spark, path, "none").collect())) == [(0, "a"), (1, "b"), (2, "none")]


def test_ordinary_tables(spark):
    bed = text(spark, "track x", "chrX 5 9 an info", "HLA*01\t7\t8", "chrX\tfive\t9", "1\t9\t5", "chrY")
    assert sorted(map(tuple, readers.read_bed(spark, bed).collect())) == [("HLA*01", 7, 8), ("chrX", 5, 9)]
    assert sorted(r.line for r in readers.rejected(spark, bed, "bed").collect()) == ["1\t9\t5", "chrX\tfive\t9", "chrY"]
    one = text(spark, "Chr Pos Allele1", "chrX 3 A", "1 4 n", "1 x C")
    assert sorted(map(tuple, readers.read_alleles(spark, one, "mono").collect())) == [("1", 3, 4, 4), ("chrX", 2, 0, 4)] and readers.read_alleles(spark, one, "poly").count() == 0
    assert [r.line for r in readers.rejected(spark, one, "alleles").collect()] == ["1 x C"]
    two = text(spark, "chr\tpos\tref\talt", "X\t3\tA\tG", "X\t4\tA\t.")
    assert list(map(tuple, readers.read_alleles(spark, two, "poly").collect())) == [("X", 2, 0, 2)]
    with pytest.raises(ValueError):
        readers.read_alleles(spark, text(spark, "Chr Pos Score", "1 2 3"))
    counts = text(spark, "chr pos ref alt p q", "chrX 5 A C 1/4 0/0", "2 6 A C 2/x 1/2")
    assert list(map(tuple, readers.read_count_table(spark, counts).collect())) == [("chrX", 5, "p", 1, 4)]
    assert [r.line for r in readers.rejected(spark, counts, "counts").collect()] == ["2 6 A C 2/x 1/2"]


def test_haploid_calls(spark):
    vcf = text(spark, "##x", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc", "chrX\t5\t.\tA\tC\t.\t.\t.\tGT:PL\t1:10,0\t0/1:9,0,9\t.:0,30", "chrX\tfive\t.\tA\tC\t.\t.\t.\tGT\t1\t1\t1", "chrX\t6")
    rows = readers.read_vcf(spark, vcf)
    got = {r.sample: (r.chrom, r.ploidy, r.gt, r.pl0, r.pl1, r.pl2) for r in rows.collect()}
    assert got == {"a": ("chrX", 1, 1, 10, None, 0), "b": ("chrX", 2, 1, 9, 0, 9), "c": ("chrX", 1, None, 0, None, 30)}
    assert readers.rejected(spark, vcf, "vcf").count() == 2
    held = rows.withColumns({"pop": F.lit("p"), "pl1": F.coalesce("pl1", F.lit(0).cast("long"))})
    freq = population.allele_freq_mixed(held, 1).first()
    a, b, c = (lambda l0, l2: l2 / (l0 + l2))(0.1, 1.0), 0.5, (lambda l0, l2: l2 / (l0 + l2))(1.0, 1e-3)
    assert freq.n_alleles == 4 and freq.freq == pytest.approx((a + 2 * b + c) / 4, abs=1e-4)
