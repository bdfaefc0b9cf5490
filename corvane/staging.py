"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a new local one where that is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder in the shared folder; it goes with what is in it when the driver ends, unless it is to stay."""
    path = _new(spark, name)
    fs, at = _located(spark, path)
    fs.mkdirs(at)
    if not keep:
        fs.deleteOnExit(at)
    return path


def _new(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str, counted: bool = False) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there. The table goes when the driver ends.

    counted: the rows are counted as they are written, for row_count().
    """
    spark = df.sparkSession
    path = _new(spark, name)
    seen = Observation() if counted else None
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if seen else df).write.parquet(path)
    fs, at = _located(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if seen:
        out.staged_rows = seen.get["n"]
    return out


def row_count(df: DataFrame) -> int:
    """The rows of a table: known if they were counted when it was written."""
    known = getattr(df, "staged_rows", None)
    return df.count() if known is None else known


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again: those made from them are written by now."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            fs, at = _located(t.sparkSession, path)
            fs.delete(at, True)
