"""Parquet tables of intermediate results: partitioned writes, replacement of single partitions, resumption, and a guard against stale inputs."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been committed at path, in any store Spark can reach."""
    fs, at = _filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(at)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Overwrite only the partitions that df has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made first if it isn't there. Spark commits a table as a whole, so a stopped run leaves none."""
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def materialised(df: DataFrame, label: str) -> DataFrame:
    """df written to the folder named by spark.checkpoint.dir and read again, for a table with several readers. Removed when the driver's JVM ends."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _filesystem(df.sparkSession, path)
    fs.deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the setting is missing and all of Spark is in one process, one of our own; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return shared


def manifest(df: DataFrame) -> dict:
    """What a table was made from: its columns and types, and the sizes of its files."""
    spark = df.sparkSession
    sizes = {}
    for f in df.inputFiles():
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))  # names of files are given as URIs
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        sizes[f] = fs.getFileStatus(at).getLen()
    return {"columns": [list(c) for c in df.dtypes], "files": dict(sorted(sizes.items()))}


def write_manifest(df: DataFrame, path: str) -> None:
    df.sparkSession.createDataFrame([(json.dumps(manifest(df)),)], "manifest string").coalesce(1).write.mode("overwrite").json(path)


def check_manifest(df: DataFrame, path: str) -> None:
    """Raise ValueError if df's columns or files aren't those of the manifest."""
    kept = json.loads(df.sparkSession.read.schema("manifest string").json(path).first().manifest)
    now = manifest(df)
    changed = [k for k in ("columns", "files") if kept[k] != now[k]]
    if changed:
        raise ValueError(f"stale input: {', '.join(changed)} changed since the table was written")
