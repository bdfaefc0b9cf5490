"""Small documents and whole tables at paths of any file system that Spark's own readers open."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


def is_uri(path: str) -> bool:
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path) is not None


def located(spark: SparkSession, path: str):
    """The file system that holds a path, and the path in its terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def size(spark: SparkSession, path: str) -> int:
    """Bytes at a path; -1 if nothing is there."""
    fs, at = located(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else -1


def read_text(path: str, spark: SparkSession | None = None) -> str:
    """A document of configuration size."""
    fs, at = located(spark or SparkSession.active(), path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8-sig")
    finally:
        stream.close()


def write_text(content: str, path: str, spark: SparkSession | None = None) -> None:
    """A document in place of what is there: it is written beside it first."""
    spark = spark or SparkSession.active()

    def write(new: str) -> None:
        fs, at = located(spark, new)
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()

    replaced(spark, path, write)


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """What write() puts at the path that it is given takes the place of what is at `path`.

    It is written beside it and renamed when it is whole, so a write that fails leaves the old file or table as it was.
    """
    fs, at = located(spark, path)
    mark = uuid.uuid4().hex
    new, old = (located(spark, f"{path.rstrip('/')}.{word}-{mark}")[1] for word in ("new", "old"))
    fs.mkdirs(at.getParent())
    try:
        write(new.toString())
    except BaseException:
        fs.delete(new, True)
        raise
    held = fs.exists(at)
    if held and not fs.rename(at, old):
        fs.delete(new, True)
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, at):
        if held:
            fs.rename(old, at)
        fs.delete(new, True)
        raise OSError(f"{path} can't be replaced")
    if held:
        fs.delete(old, True)
