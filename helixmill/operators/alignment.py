"""Reads as aligned: lengths from the CIGAR, and a row for each base at the place where the CIGAR puts it.

A CIGAR is an array of (op, n). One fold over it carries how far the read and the reference have come and gives runs of
bases of one kind; runs are exploded, then their bases. The text of a sequence is only touched for bases that are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixmill.operators.reads import PROPER, REVERSE, has

CIGAR = "array<struct<op:string,n:bigint>>"
RUNS = "array<struct<kind:string,read:bigint,ref:bigint,n:bigint>>"
LETTERS = "ACGT"
N = 4


def parsed_cigar(text: str | Column) -> Column:
    """The text of a CIGAR as an array of (op, n); null where it is none: ``*``, an unknown operation, or a piece left over."""
    text = F.col(text) if isinstance(text, str) else text
    n, op = F.regexp_extract_all(text, F.lit(r"(\d+)[MIDNSHP=X]"), F.lit(1)), F.regexp_extract_all(text, F.lit(r"\d+([MIDNSHP=X])"), F.lit(1))
    ops = F.zip_with(op, n, lambda o, k: F.struct(o.alias("op"), k.cast("bigint").alias("n")))
    return F.when(text.rlike(r"^(\d+[MIDNSHP=X])+$"), ops)


def cigar_text(cigar: str | Column = "cigar") -> Column:
    return F.array_join(F.transform(cigar, lambda c: F.concat(c["n"].cast("string"), c["op"])), "")


def length(*ops: str, cigar: str | Column = "cigar") -> Column:
    return F.aggregate(cigar, F.lit(0).cast("bigint"), lambda a, c: F.when(c["op"].isin(*ops), a + c["n"]).otherwise(a))


def clipped_left(cigar: str = "cigar") -> Column:
    """Soft-clipped bases before the first sequenced one; hard clips may stand before them."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("on"))
    add = lambda a, c: F.struct((a["n"] + F.when(a["on"] & (c["op"] == "S"), c["n"]).otherwise(0)).alias("n"), (a["on"] & c["op"].isin("S", "H", "P")).alias("on"))
    return F.aggregate(cigar, start, add)["n"]


def with_lengths(reads: DataFrame) -> DataFrame:
    """Adds aligned, inserted, deleted, skipped and clipped bases; sequenced (aligned and inserted), mapped (on the reference) and read_length (all in the sequence)."""
    rows = reads.withColumns({"aligned": length("M", "=", "X"), "inserted": length("I"), "deleted": length("D"), "skipped": length("N"), "clipped": length("S")})
    return rows.withColumns({"sequenced": F.expr("aligned + inserted"), "mapped": F.expr("aligned + deleted + skipped"), "read_length": F.expr("aligned + inserted + clipped")})


def fragment() -> Column:
    """Of rows with flag, tlen and lengths: of a proper pair |TLEN| and what is inserted less what is deleted, at least 0; else what is sequenced."""
    return F.when(has(PROPER), F.greatest(F.lit(0).cast("bigint"), F.abs("tlen") + F.col("inserted") - F.col("deleted"))).otherwise(F.col("sequenced"))


def runs(cigar: str = "cigar") -> Column:
    """Runs of bases: kind (M aligned, I inserted, S clipped), the first one's place in the read and on the reference from the read's start, and n."""
    start = F.struct(F.array().cast(RUNS).alias("runs"), F.lit(0).cast("bigint").alias("read"), F.lit(0).cast("bigint").alias("ref"))

    def add(acc: Column, c: Column) -> Column:
        aligned, in_read, zero = c["op"].isin("M", "=", "X"), c["op"].isin("M", "=", "X", "I", "S"), F.lit(0).cast("bigint")
        run = F.struct(F.when(aligned, "M").otherwise(c["op"]).alias("kind"), acc["read"].alias("read"), acc["ref"].alias("ref"), c["n"].alias("n"))
        return F.struct(
            F.when(in_read & (c["n"] > 0), F.concat(acc["runs"], F.array(run))).otherwise(acc["runs"]).alias("runs"),
            (acc["read"] + F.when(in_read, c["n"]).otherwise(zero)).alias("read"),
            (acc["ref"] + F.when(aligned | c["op"].isin("D", "N"), c["n"]).otherwise(zero)).alias("ref"),
        )

    return F.aggregate(cigar, start, add, lambda acc: acc["runs"])


def walked(reads: DataFrame, kinds: str = "M") -> DataFrame:
    """A row for each base of the kinds: all columns of reads but cigar, and kind, at (its place in the read) and site, null unless aligned.

    reads have pos and cigar. A null or empty CIGAR gives no rows; null places no site.
    """
    chosen = runs() if set(kinds) == set("MIS") else F.filter(runs(), lambda r: r["kind"].isin(*kinds))
    rest = [c for c in reads.columns if c != "cigar"]
    rows = reads.select(*rest, F.inline(chosen).alias("kind", "_read", "_ref", "_n"))
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    site = F.when(F.col("kind") == "M", F.col("pos") + F.col("_ref") + F.col("_i")) if set(kinds) != {"M"} else F.col("pos") + F.col("_ref") + F.col("_i")
    return rows.withColumns({"at": F.col("_read") + F.col("_i"), "site": site}).drop("_read", "_ref", "_n", "_i")


def code(letter: Column) -> Column:
    """0 to 3 for a base, 4 for anything else."""
    place = F.instr(F.lit(LETTERS), F.upper(letter))
    return F.when((F.length(letter) == 1) & (place > 0), place - 1).otherwise(N).cast("long")


#: By code point: 0 to 3 for a base, 4 for anything else.
CODES = [LETTERS.find(chr(i).upper()) if chr(i).upper() in LETTERS else N for i in range(128)]


def point_code(point: Column) -> Column:
    """The same of a base's code point."""
    return F.coalesce(F.get(F.array(*map(F.lit, CODES)), point), F.lit(N)).cast("long")


def bases(reads: DataFrame, kinds: str = "M", keep: tuple[str, ...] = (), with_context: bool = False) -> DataFrame:
    """read_id, chrom, site, kind, at, off, base, qual, d5, d3, is_rev and ``keep`` of each base of the kinds; frag can be kept too.

    reads: read_id, chrom, pos, flag, tlen, cigar, seq and quality (text, from ``!`` on). off counts sequenced bases from
    the left, d5 and d3 from the ends of the fragment as it was sequenced: of a proper pair d3 counts on to the other
    mate's end, of others to the read's own. They are null for clipped bases. with_context adds prev, the base sequenced
    before it, complemented on reverse reads; 4 if there is none. Reads whose text has another length than their CIGAR
    give no rows; ``malformed`` lists them.
    """
    rows = with_lengths(reads).withColumns({"_left": clipped_left(), "frag": fragment(), "is_rev": has(REVERSE).cast("int")})
    rows = rows.where((F.length("seq") == F.col("read_length")) & (F.length("quality") == F.col("read_length")))
    names = ["read_id", "chrom", "is_rev", *keep]
    plain = (F.octet_length("seq") == F.col("read_length")) & (F.octet_length("quality") == F.col("read_length"))
    rows = rows.withColumns({"_proper": has(PROPER), "_plain": plain, "_seq": F.col("seq").cast("binary"), "_quality": F.col("quality").cast("binary")})
    held = walked(rows.select(*dict.fromkeys([*names, "pos", "cigar", "seq", "quality", "_seq", "_quality", "_plain", "sequenced", "_left", "frag", "_proper"])), kinds)

    def spot(c: str, i: Column) -> Column:
        """The code point at a place; where every character is a byte it need not be counted to."""
        i = (i + 1).cast("int")
        return F.ascii(F.when(F.col("_plain"), F.substring(F.col(f"_{c}"), i, F.lit(1)).cast("string")).otherwise(F.substring(F.col(c), i, F.lit(1))))

    held = held.withColumns({"off": F.col("at") - F.col("_left"), "base": point_code(spot("seq", F.col("at"))), "qual": (spot("quality", F.col("at")) - 33).cast("long")})
    off, rev, whole = F.col("off"), F.col("is_rev") == 1, F.col("sequenced")
    back = whole - 1 - off
    inside = F.col("kind") != "S" if "S" in kinds else F.lit(True)
    d3 = F.when(F.col("_proper"), F.when(rev, off + F.col("frag") - whole).otherwise(F.col("frag") - 1 - off)).otherwise(F.when(rev, off).otherwise(back))
    held = held.withColumns({"d5": F.when(inside, F.when(rev, back).otherwise(off)), "d3": F.when(inside, d3), "off": F.when(inside, off)})
    if with_context:
        held = held.withColumn("_next", point_code(spot("seq", F.when(rev, F.col("at") + 1).otherwise(F.greatest(F.col("at") - 1, F.lit(0))))))
        held = held.withColumn("prev", F.when(rev, F.when(F.col("_next") < N, 3 - F.col("_next")).otherwise(N)).otherwise(F.when(F.col("at") > 0, F.col("_next")).otherwise(N)))
    return held.select("read_id", "chrom", "site", "kind", "at", "off", "base", "qual", "d5", "d3", "is_rev", *keep, *(["prev"] if with_context else []))


def malformed(reads: DataFrame) -> DataFrame:
    """Reads that give no bases, with the reason: no CIGAR, no sequence, or a text of another length than the CIGAR's."""
    rows = reads.withColumn("_n", length("M", "=", "X", "I", "S"))
    reason = F.when(F.col("cigar").isNull(), "no cigar").when(F.col("seq").isNull() | (F.col("seq") == "*"), "no sequence")
    reason = reason.when(F.length("seq") != F.col("_n"), "sequence length").when(F.col("quality").isNull() | (F.length("quality") != F.col("_n")), "quality length")
    return rows.withColumn("reason", reason).where("reason IS NOT NULL").drop("_n")
