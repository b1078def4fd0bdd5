"""Tables and text files that other programs exchange, written and read by Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def scratch(spark: SparkSession) -> str:
    """A new path in the session's shared folder; where none is set and all runs in one JVM, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: cuts lineage, and survives a lost executor."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_sites(sites: DataFrame, path: str) -> None:
    """Depth, root mean square mapping quality and likelihoods, 4 or 10, as 16-bit integers, -1000 log10, by chromosome."""
    packed = F.transform("gl", lambda x: F.least(F.lit(32767), F.floor(-1000 * F.log10(x) + 0.5)).cast("short"))
    sites.select("chrom", "site", "depth", "rms_mapq", packed.alias("packed")).write.partitionBy("chrom").parquet(path)


def read_sites(spark: SparkSession, path: str, n: int = 10) -> DataFrame:
    rows = spark.read.schema("site bigint, depth bigint, rms_mapq bigint, packed array<smallint>, chrom bigint").parquet(path)
    return rows.select("chrom", "site", "depth", "rms_mapq", *(F.element_at("packed", i + 1).cast("long").alias(f"q{i}") for i in range(n)))


def write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, compression="gzip")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, sep="\t", header=True)
