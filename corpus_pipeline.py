"""From documents to token ids: quality rules, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Columns of docs are carried in one
struct, so none of their names can clash with those that an operator adds. A row is known by a digest of all its columns,
not by its id: rows without an id, or with one that others have too, are judged by their own texts. Empty tables stay
empty; null texts have no words, so the quality rules reject them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm import positional_index, prefix_bpe, quality, secrets, simhash
from helixmill.llm.common import small, stored, table

MASK = "[secret]"
FEW = 500_000  #: digests, of 16 bytes each, that are broadcast at most


def carried(docs: DataFrame) -> DataFrame:
    """_all, every column; _row, the digest of them, in which the text has its own; doc_id and text."""
    every = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    row = F.unhex(F.md5(F.concat(F.coalesce(F.md5("text"), F.lit("none")), others)))
    return docs.select(every.alias("_all"), row.alias("_row"), "doc_id", "text")


def without(rows: DataFrame, digests: DataFrame) -> DataFrame:
    return rows.join(small(digests.select("_row").distinct(), FEW), "_row", "left_anti")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated ones."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), F.col("lang").alias("stratum"), "doc_id", "text")
    rows = stored(quality.with_counts(rows, ["_all", "stratum", "doc_id"]))
    cutoffs = quality.calibrate(rows.drop("_all"), table(spark, sf_dir, "labels"))
    return quality.judged(rows, cutoffs).where("kept").select("_all.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id; one without an id if all are so."""
    rows = carried(docs)
    gone = stored(simhash.repeats(rows.select("doc_id", "text", F.col("_row").alias("row"))).withColumnRenamed("row", "_row"))
    kept, extra = without(rows, gone), gone.where("extra").select("_row")
    if extra.limit(1).count():  # of rows that are equal in all columns one stays
        kept = kept.unionByName(rows.join(extra, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.select("_all.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than 5 % of the words are in passages of the benchmark."""
    rows = carried(docs)
    hits = positional_index.phrases(positional_index.build(rows, "_row"), table(spark, sf_dir, "benchmark"), out="_row")
    return without(rows, positional_index.contamination(hits, "_row").where("contaminated")).select("_all.*")


def masked(text: Column, found: Column) -> Column:
    """text with each span of found, which is sorted, replaced; spans that overlap become one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def add(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(found, start, add, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked, and n_chars, if there is one, that of the masked text."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_all"), "text")
    found = secrets.scan(rows, ["_all"])
    text = F.when(F.size("found") > 0, masked(F.col("_all.text"), F.col("found"))).otherwise(F.col("_all.text"))
    own = {"text": lambda: text, "n_chars": lambda: F.when(F.size("found") > 0, F.length(text).cast("long")).otherwise(F.col("_all.n_chars"))}
    return found.select(*(own[c]().alias(c) if c in own else F.col(f"_all.`{c}`") for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the token ids."""
    rows = prefix_bpe.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "lang", "source"])
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding", encoding),
]

#: SQL can't express the covering search or the token ids; tests hold the stages and the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
