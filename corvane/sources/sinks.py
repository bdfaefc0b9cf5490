"""Writers: CSV and JSON tables through Spark, small YAML and Markdown documents through the driver.

Each writes beside what is there and takes its place when it is whole; a write that fails leaves the old one.
"""

from __future__ import annotations

import json
from typing import Any

import yaml
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.sources.files import replaced, write_text
from corvane.sources.readers import ORDER
from corvane.staging import staged


def flat(df: DataFrame) -> DataFrame:
    """df without its order column and with nested cells as JSON text, as CSV needs it."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields if f.name != ORDER])


def ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(ORDER) if ORDER in df.columns else df


def _written(df: DataFrame, path: str, write) -> int:
    """write(counted df, path) in place of what is there; the number of rows, counted as they are written."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("n"))
    replaced(df.sparkSession, path, lambda new: write(counted, new))
    return seen.get["n"]


def write_csv(df: DataFrame, path: str) -> int:
    """A folder of CSV parts with headers, in the rows' order, replacing what is there. Returns the number of rows."""
    return _written(flat(ordered(df)), path, lambda d, at: d.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(at))


def write_json(df: DataFrame, path: str) -> int:
    """A folder of JSON Lines, nested values kept. Returns the number of rows."""
    return _written(ordered(df).drop(ORDER), path, lambda d, at: d.write.option("ignoreNullFields", False).json(at))


def write_json_document(tables: dict[str, DataFrame], path: str) -> None:
    """A folder of text parts that, one after the other, are one JSON document: {"name": [rows, in order], ...}.

    Every part is written by a task, so the document may be of any size; `hadoop fs -getmerge` or `cat` makes one file.
    """
    spark = next(iter(tables.values())).sparkSession
    fixed = lambda i, line: spark.createDataFrame([(i, -1, line)], "part int, k long, value string")
    out = fixed(len(tables), "]}")
    for i, (name, df) in enumerate(tables.items()):
        value = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != ORDER]), {"ignoreNullFields": "false"})
        rows = staged(df.orderBy(ORDER).select(F.monotonically_increasing_id().alias("k"), value.alias("value")), "document-rows")
        first = rows.agg(F.min("k")).first()[0]
        comma = F.when(F.col("k") == first, "").otherwise(",")
        out = out.unionByName(fixed(i, f"{'{' if i == 0 else '],'}{json.dumps(name)}: ["))
        out = out.unionByName(rows.select(F.lit(i).alias("part"), "k", F.concat(comma, "value").alias("value")))
    replaced(spark, path, lambda new: out.orderBy("part", "k").select("value").write.text(new))


def write_yaml(payload: Any, path: str) -> None:
    """A configuration-sized document; keys stay in order."""
    write_text(yaml.safe_dump(payload, allow_unicode=True, sort_keys=False), path)


def write_markdown(report: str, path: str) -> None:
    write_text(report, path)


def as_rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a small result in order, for a document."""
    return [r.asDict(recursive=True) for r in ordered(df).drop(ORDER).collect()] if ORDER not in df.columns else [{k: v for k, v in r.asDict(recursive=True).items() if k != ORDER} for r in ordered(df).collect()]
