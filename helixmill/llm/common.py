"""Helpers that the text operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reachable(spark: SparkSession) -> None:
    """Workers that see this file system import the package from where the driver found it, whatever their folder is.

    Every operator with Python workers calls it. On a cluster whose workers don't see it the package is installed or sent.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and the session runs in one JVM
    (tests) does a temporary folder stand in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.sparkContext.getCheckpointDir()
        if base is None:
            base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/helixmill-{uuid.uuid4().hex}"


def stored(df: DataFrame, **options) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, and survives a lost executor."""
    path = shared_dir(df.sparkSession)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """df, stored, marked for broadcast if it is counted to have at most ``rows`` rows; else left to a shuffled join."""
    df = stored(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions")) * factor
