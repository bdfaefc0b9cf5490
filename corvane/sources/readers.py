"""Readers: all-string CSV, JSON and YAML records, configuration, and the choice between a primary source and a fixture."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import clean_list, or_default, split_keywords, stable_id, strip_long, text
from corvane.sources.files import is_uri, read_text, size
from corvane.staging import staged

#: The order of rows in a source; results that depend on order carry it along.
ORDER = "_ord"
PAPER_FIELDS = ("paper_id", "title", "abstract", "year", "doi", "pmid", "source", "keywords", "url", "notes")


class ConfigError(KeyError):
    """A path or section that the configuration must name is absent."""


class Config:
    """Nested settings from YAML, with paths relative to a root folder, which may be a URI as any path may."""

    def __init__(self, values: dict[str, Any], root: str | Path):
        self.values, self.root = values, str(root)

    @classmethod
    def load(cls, path: str | Path, root: str | Path | None = None, spark: SparkSession | None = None) -> Config:
        """A configuration file; a URI is opened by the session's file systems, other paths on the local disk."""
        if is_uri(str(path)):
            content, above = read_text(str(path), spark), str(path).rsplit("/", 2)[0]
        else:
            at = Path(path).resolve()
            content, above = at.read_text(encoding="utf-8"), at.parent.parent
        return cls(yaml.safe_load(content) or {}, root or above)

    def section(self, name: str) -> dict[str, Any]:
        return self.values.get(name) or {}

    def path(self, section: str, key: str, default: str | None = None) -> str:
        value = self.section(section).get(key, default)
        if value is None:
            raise ConfigError(f"{section}.{key}")
        value = str(value)
        if is_uri(value):
            return value
        return f"{self.root.rstrip('/')}/{value.lstrip('/')}" if is_uri(self.root) else str(Path(self.root) / value)

    def given(self, section: str, key: str) -> bool:
        return self.section(section).get(key) is not None

    def primary_or_fixture(self, spark: SparkSession, section: str, primary: str, fixture: str) -> str:
        """The primary path if something of more than 0 bytes is there, else the fixture's."""
        at = self.path(section, primary) if self.given(section, primary) else None
        return at if at and size(spark, at) > 0 else self.path(section, fixture)


def numbered(raw: DataFrame) -> DataFrame:
    """raw, as a file reader gives it, with the rows' order: files by name (a longer name later, as part numbers grow), and in
    a file from its start to its end.

    Spark deals blocks of files to tasks by size. So rows are written with their file, block and running number; a
    block's rows come after those of all blocks before it, which a prefix sum over the blocks' counts tells. A single file that
    isn't split needs none of that.
    """
    if len(raw.inputFiles()) <= 1 and getattr(raw, "whole_files", False):
        return raw.withColumn(ORDER, F.monotonically_increasing_id())
    told = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    rows = staged(told.withColumn("__at", F.monotonically_increasing_id()), "source-rows")
    blocks = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    by = Window.orderBy(F.length("__file"), "__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("__file", "__block", "__first", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("__offset"))
    place = F.col("__offset") + F.col("__at") - F.col("__first")
    # There is a row for each block, so they go to the rows, which stay where they are.
    return rows.join(F.broadcast(offsets), ["__file", "__block"]).select(*[F.col(f"`{c}`") for c in raw.columns], place.alias(ORDER))


def rising(raw: DataFrame, path: str) -> DataFrame:
    """raw, from files at `path` that aren't split, with numbers that rise in the order of numbered() but have gaps: a row's file's
    rank, then its running number. That asks for no counts, so nothing is written."""
    # Spark itself lists the files, so their names are those that the rows tell; no content is read.
    files = raw.sparkSession.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("__file"))
    ranks = files.select("__file", F.row_number().over(Window.orderBy(F.length("__file"), "__file")).cast("bigint").alias("__rank"))
    # The running number is a task's, which reads a file from start to end.
    told = raw.select("*", F.col("_metadata.file_path").alias("__file"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__at"))
    rank = F.coalesce("__rank", F.raise_error(F.concat(F.lit("not among the files listed: "), "__file")).cast("bigint"))
    met = told.join(F.broadcast(ranks), "__file", "left")
    return met.select(*[F.col(f"`{c}`") for c in raw.columns], (F.shiftleft(rank, 33) + F.col("__at")).alias(ORDER))


def _whole(raw: DataFrame) -> DataFrame:
    raw.whole_files = True
    return raw


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, order: str = "places") -> DataFrame:
    """All columns as strings, absent cells empty, with the row's order. Quotes are doubled within quotes.

    multi_line: cells may hold line ends, so a file isn't split; without it, tasks share large files.
    order: `places` (0, 1, 2, ...), for which rows are written once on the way; `rising`, numbers with gaps, for which files that
    aren't split need not be; or `none`, where nothing asks for it.
    """
    raw = spark.read.csv(path, header=True, multiLine=multi_line, escape='"', inferSchema=False)
    if order == "none":
        return raw.fillna("")
    rows = rising(raw, path) if order == "rising" and multi_line else numbered(_whole(raw) if multi_line else raw)
    return rows.fillna("")


def read_yaml(path: str, spark: SparkSession | None = None) -> Any:
    """A configuration-sized YAML document; an empty one is {}."""
    return yaml.safe_load(read_text(path, spark)) or {}


def _records(spark: SparkSession, rows: list[dict[str, Any]]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    as_text = lambda v: "" if v is None else ";".join(map(str, v)) if isinstance(v, list) else str(v)
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(ORDER, T.LongType())])
    return spark.createDataFrame([(*[as_text(r.get(n)) for n in names], i) for i, r in enumerate(rows)], schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a .csv, .json, .yaml or .yml file. JSON is read by Spark: JSON Lines, an array of objects, or a document
    that holds them under `records`; anything malformed is an error. YAML, which Spark has no reader for, is
    configuration-sized and read whole."""
    kind = Path(path).suffix.lower()
    if kind == ".csv":
        return read_csv(spark, path)
    if kind == ".json":
        return _json(spark, path)
    if kind in (".yaml", ".yml"):
        payload = read_yaml(path, spark)
        return _records(spark, payload.get("records", []) if isinstance(payload, dict) else payload)
    raise ValueError(f"no reader for {path}: .csv, .json, .yaml or .yml is expected")


def _json(spark: SparkSession, path: str) -> DataFrame:
    none = spark.createDataFrame([], f"paper_id string, {ORDER} long")
    first = spark.read.text(path).filter("trim(value) <> ''").first()
    if first is None:
        return none
    # A document spread over lines begins with one that isn't JSON by itself.
    try:
        json.loads(first["value"])
        spread = False
    except ValueError:
        spread = True
    whole = spark.read.json(path, multiLine=spread, mode="FAILFAST")
    rows = numbered(_whole(whole) if spread else whole)
    if "records" not in whole.columns:
        return rows
    kind = whole.schema["records"].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        each = rows.select(F.col(ORDER).alias("__file"), F.posexplode("records").alias("__at", "__record"))
        # A document's records are fewer than 2^31.
        return each.select("__record.*", (F.shiftleft("__file", 31) + F.col("__at")).alias(ORDER))
    return none if isinstance(kind, T.ArrayType) else rows


def normalize_literature(rows: DataFrame) -> DataFrame:
    """Paper records: trimmed fields, year only of digits, an id of content where none is given, keywords as a list."""
    have = set(rows.columns)
    cell = lambda c: strip_long(F.col(c)) if c in have else F.lit("")
    digits = F.when(cell("year").rlike(r"^\d+$"), cell("year"))
    # The id tells the year as the number that was read: without leading zeros, and nothing where there is none or zero.
    told = F.regexp_replace(digits, r"^0+", "")
    keywords = F.lit(None).cast("array<string>")
    if "keywords" in have:
        is_list = isinstance(rows.schema["keywords"].dataType, T.ArrayType)
        keywords = clean_list(F.col("keywords")) if is_list else split_keywords(F.col("keywords"))
    return rows.select(
        or_default(cell("paper_id"), stable_id("paper", cell("title"), cell("abstract"), told)).alias("paper_id"),
        cell("title").alias("title"),
        cell("abstract").alias("abstract"),
        digits.try_cast("bigint").alias("year"),
        *[cell(c).alias(c) for c in ("doi", "pmid", "source")],
        F.coalesce(keywords, F.array().cast("array<string>")).alias("keywords"),
        cell("url").alias("url"),
        cell("notes").alias("notes"),
        F.col(ORDER) if ORDER in have else F.monotonically_increasing_id().alias(ORDER),
    )


def load_literature(spark: SparkSession, path: str) -> DataFrame:
    return normalize_literature(read_records(spark, path))


def load_mapping_rules(path: str, spark: SparkSession | None = None) -> list[tuple[str, str, list[str]]]:
    """(concept, modality, candidates) of a rule file; the rules may stand under `mappings`."""
    payload = read_yaml(path, spark)
    rules = payload.get("mappings", payload)
    return [(str(k), str(v.get("modality", "")), [str(x) for x in v.get("candidates", [])]) for k, v in rules.items()]


def load_confounds(path: str, spark: SparkSession | None = None) -> list[str]:
    return [str(x) for x in read_yaml(path, spark).get("confounds", [])]


def load_approved(path: str, spark: SparkSession | None = None) -> list[str]:
    """Approved names: a flat list under `approved_variables`, a bare list, or lists by bucket, which are joined."""
    payload = read_yaml(path, spark)
    if isinstance(payload, dict):
        payload = payload["approved_variables"] if "approved_variables" in payload else [x for v in payload.values() for x in v or []]
    return [str(x) for x in payload]


def document_text(papers: DataFrame) -> F.Column:
    """Title, abstract, keywords and notes as one text."""
    return F.concat_ws(" ", text(F.col("title")), text(F.col("abstract")), F.array_join("keywords", " "), text(F.col("notes")))
