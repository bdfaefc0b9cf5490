"""Column profiles: missingness and kind of every column, approval against thresholds, dictionary and data profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import MASTER_MISSING, MISSING, is_missing, is_number, is_truthy, missing_rate, or_default, quoted, text
from corvane.operators.entities import KEY_NAMES, MODALITIES
from corvane.sources.readers import ORDER

# Columns with a role of their own, values that a group may have, and the names of the lists of approved columns.
COVARIATES = ("age", "sex", "education", "medication", "mean_FD", "in_scanner_sleep_time")
OUTCOMES = ("ISI", "PSQI")
SCALES = ("anxiety_score", "depression_score")
GROUPS = ("HC", "INS")
ROLE_BUCKETS = ("covariates", "group", "qc")
PASSED = "passes missingness and sample-size thresholds"
PROFILE = "feature_name string, modality string, source_file string, source_column string, missing_rate double, n_available bigint, qc_status string, approved boolean, role string"


@dataclass(frozen=True)
class Thresholds:
    primary: float = 0.35
    secondary: float = 0.35
    min_n: int = 1


@dataclass(frozen=True)
class ReadyRules:
    max_missing_rate: float = 0.4
    min_n: int = 1
    qc: tuple[str, ...] = ("pass", "usable")


@dataclass(frozen=True)
class Roles:
    """Which columns have a role of their own."""

    group: str = "group"
    covariates: tuple[str, ...] = COVARIATES
    outcomes: tuple[str, ...] = OUTCOMES
    scales: tuple[str, ...] = SCALES
    qc_prefix: str = "qc"


def role_of(name: Column, roles: Roles = Roles()) -> Column:
    return (
        F.when(name == roles.group, "group")
        .when(name.isin(*roles.covariates), "covariate")
        .when(name.isin(*roles.outcomes), "outcome")
        .when(name.isin(*roles.scales), "scale")
        .when(F.lower(name).startswith(roles.qc_prefix), "qc")
        .otherwise("feature")
    )


def column_stats(df: DataFrame, columns: Sequence[str], missing: Sequence[str] = MISSING) -> DataFrame:
    """(column, position, total, available, numeric), a row for each column if df has rows: one pass over df.

    The plan doesn't grow with the number of columns: a row's cells are one array, each cell becomes a code by one function, and
    codes are counted by position, map-side first. So tables of thousands of columns are profiled as others are.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, position int, total long, available long, numeric boolean")
    # Expressions as text, and names as one literal: thousands of columns would take as many calls to the JVM each.
    cells = F.expr("array(" + ", ".join(f"cast({quoted(c)} as string)" for c in columns) + ")")
    code = lambda c: F.when(is_missing(c, missing), 0).when(is_number(c), 2).otherwise(1)
    each = df.select(F.posexplode(F.transform(cells, code)).alias("position", "code"))
    counts = each.groupBy("position").agg(F.count("*").alias("total"), F.count_if(F.col("code") > 0).alias("available"), (F.count_if(F.col("code") == 1) == 0).alias("numeric"))
    name = F.get(F.split(F.lit("\x1f".join(columns)), "\x1f"), F.col("position"))
    return counts.select(name.alias("column"), "position", "total", "available", "numeric")


def kind_of(available: Column, numeric: Column) -> Column:
    return F.when(available == 0, "unknown").when(numeric, "numeric").otherwise("categorical")


def registry(tables: Mapping[str, tuple[DataFrame, str]], keys: Sequence[str] = KEY_NAMES, roles: Roles = Roles()) -> DataFrame:
    """A record for every column but keys of each table (modality: table and where it came from), in their order."""
    out = None
    for rank, (modality, (df, source)) in enumerate(tables.items()):
        columns = [c for c in df.columns if c not in keys and c not in ("subject_id", ORDER)]
        stats = column_stats(df, columns).filter("total > 0")
        rows = stats.select(
            F.col("column").alias("feature_name"),
            F.lit(modality).alias("modality"),
            F.lit(source).alias("source_file"),
            F.col("column").alias("source_column"),
            role_of(F.col("column"), roles).alias("role"),
            kind_of(F.col("available"), F.col("numeric")).alias("dtype"),
            F.lit("").alias("unit"),
            F.concat(F.lit(f"{modality} variable "), F.col("column")).alias("description"),
            missing_rate(F.col("available"), F.col("total")).alias("missing_rate"),
            F.col("available").alias("n_available"),
            F.array(F.lit(modality)).alias("qc_dependency"),
            F.lit(False).alias("approved"),
            F.lit("pending approval").alias("approval_reason"),
            (F.lit(rank).cast("long") * 100000 + F.col("position")).alias(ORDER),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def approved(records: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """records with approved and approval_reason by role: outcomes and groups keep to the primary limit. Unknown figures pass."""
    limit = F.when(F.col("role").isin("outcome", "group"), F.lit(thresholds.primary)).otherwise(F.lit(thresholds.secondary))
    named = F.when(F.col("role").isin("outcome", "group"), F.lit(str(thresholds.primary))).otherwise(F.lit(str(thresholds.secondary)))
    reason = (
        F.when(F.col("missing_rate") > limit, F.concat(F.lit("missing_rate>"), named))
        .when(F.col("n_available") < thresholds.min_n, F.lit(f"n_available<{thresholds.min_n}"))
        .otherwise(PASSED)
    )
    return records.withColumn("approval_reason", reason).withColumn("approved", F.col("approval_reason") == PASSED)


def bucket(modalities: Sequence[str] = MODALITIES) -> Column:
    role, modality = F.col("role"), F.col("modality")
    return F.when(role == "covariate", "covariates").when(role == "group", "group").when(role == "qc", "qc").when(modality.isin(*modalities), modality)


def approved_buckets(records: DataFrame, modalities: Sequence[str] = MODALITIES) -> DataFrame:
    """(bucket, names): sorted distinct names of approved columns; every modality's list is there, and those of the roles."""
    spark = records.sparkSession
    found = records.filter("approved").select(bucket(modalities).alias("bucket"), "feature_name").filter("bucket IS NOT NULL")
    lists = found.groupBy("bucket").agg(F.array_sort(F.collect_set("feature_name")).alias("names"))
    every = spark.createDataFrame(list(enumerate(dict.fromkeys([*modalities, *ROLE_BUCKETS]))), f"{ORDER} long, bucket string")
    return every.join(lists, "bucket", "left").select("bucket", F.coalesce("names", F.array().cast("array<string>")).alias("names"), ORDER)


def dictionary(records: DataFrame) -> DataFrame:
    values = F.when(F.col("feature_name") == "group", F.array(*map(F.lit, GROUPS))).otherwise(F.array().cast("array<string>"))
    return records.select(
        F.col("feature_name").alias("variable"), "modality", "role", "description", "unit", "source_file", "source_column", values.alias("allowed_values"), F.lit(None).cast("array<double>").alias("valid_range"), ORDER
    )


def observed_profile(records: DataFrame, master: DataFrame, approved_names: Sequence[str] = (), source: str = "master") -> DataFrame:
    """Registry rows with missingness measured on the merged table; columns it lacks have none."""
    have = lambda c, default: text(F.col(c)) if c in records.columns else F.lit(default)
    column = or_default(have("source_column", ""), have("feature_name", ""))
    stats = column_stats(master, [c for c in master.columns if c != ORDER], MASTER_MISSING).filter("total > 0")
    stats = stats.select(F.col("column").alias("__column"), "total", "available")
    named = records.withColumn("__column", column).join(stats, "__column", "left")
    listed = F.col("feature_name").isin(*approved_names) if approved_names else F.lit(False)
    return named.select(
        have("feature_name", "").alias("feature_name"),
        have("modality", "").alias("modality"),
        have("source_file", source).alias("source_file"),
        F.col("__column").alias("source_column"),
        F.when(F.col("total").isNotNull(), missing_rate(F.col("available"), F.col("total"))).alias("missing_rate"),
        F.col("available").alias("n_available"),
        have("qc_status", "pass").alias("qc_status"),
        (is_truthy(have("approved", "")) | listed).alias("approved"),
        have("role", "feature").alias("role"),
        ORDER,
    )


def theoretical_profile(evidence: DataFrame) -> DataFrame:
    """What the evidence asks for: each variable (or else mechanism) once, with the modality it is first seen with."""
    named = evidence.withColumn("__name", or_default(F.col("variable_or_feature"), F.col("mechanism"))).filter("__name <> ''")
    first = named.groupBy("__name").agg(F.min_by("modality", ORDER).alias("modality"), F.min(ORDER).alias(ORDER))
    return first.select(
        F.col("__name").alias("feature_name"),
        "modality",
        F.lit("literature_grounding").alias("source_file"),
        F.col("__name").alias("source_column"),
        F.lit(None).cast("double").alias("missing_rate"),
        F.lit(None).cast("bigint").alias("n_available"),
        F.lit("").alias("qc_status"),
        F.lit(False).alias("approved"),
        F.lit("feature").alias("role"),
        ORDER,
    )


def analysis_ready(profile: DataFrame, rules: ReadyRules = ReadyRules()) -> DataFrame:
    """Approved columns within the limits; figures that are unknown pass."""
    passes = lambda c: F.coalesce(c, F.lit(True))
    return profile.filter(
        F.col("approved")
        & passes(F.col("missing_rate") <= rules.max_missing_rate)
        & passes(F.col("n_available") >= rules.min_n)
        & ((text(F.col("qc_status")) == "") | F.lower("qc_status").isin(*[x.lower() for x in rules.qc]))
    )


def most_missing(records: DataFrame, k: int = 20) -> DataFrame:
    """The k columns with the highest missing rate; ties in registry order."""
    return records.withColumn("__rate", F.coalesce("missing_rate", F.lit(0.0))).orderBy(F.desc("__rate"), ORDER).limit(k).drop("__rate")
