"""Figures that the reports tell: sizes, coverage, totals and warnings, each a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources.readers import ORDER

# Status words in the report's order, and columns that a study should hold.
STATUS_ORDER = ("pass", "caution", "fail", "unknown")
KEY_COVARIATES = ("age", "sex")


def qc_histogram(records: DataFrame) -> DataFrame:
    """(qc_status, n): all four words are listed."""
    every = records.sparkSession.createDataFrame(list(enumerate(STATUS_ORDER)), f"{ORDER} long, qc_status string")
    counts = records.groupBy("qc_status").agg(F.count("*").alias("n"))
    return every.join(counts, "qc_status", "left").select("qc_status", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), ORDER)


def group_sizes(subjects: DataFrame) -> DataFrame:
    """(group, n) of subjects that have a group."""
    return subjects.filter("`group` <> ''").groupBy("group").agg(F.count("*").alias("n"))


def coverage_counts(covered: DataFrame) -> DataFrame:
    """(modality, n): how many subjects each source holds. covered: distinct (subject_id, modality)."""
    return covered.groupBy("modality").agg(F.count("*").alias("n"))


def modality_summary(covered: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, n_subjects, n_approved, names): each list of approved columns beside the subjects that its source holds."""
    sizes = coverage_counts(covered).select(F.col("modality").alias("bucket"), F.col("n").alias("n_subjects"))
    held = F.coalesce("n_subjects", F.lit(0)).cast("bigint").alias("n_subjects")
    return buckets.join(sizes, "bucket", "left").select("bucket", held, F.size("names").cast("bigint").alias("n_approved"), "names", ORDER)


def feature_counts(records: DataFrame) -> DataFrame:
    """(modality, n) of registry rows, sorted by modality."""
    return records.groupBy("modality").agg(F.count("*").alias("n")).orderBy("modality")


def approved_totals(buckets: DataFrame) -> DataFrame:
    """(bucket, n): how many approved columns each list holds."""
    return buckets.select("bucket", F.size("names").cast("bigint").alias("n"), ORDER)


def _told(df: DataFrame, message: Column, part: int, at: Column, name: Column) -> DataFrame:
    place = F.struct(F.lit(part).alias("part"), at.cast("bigint").alias("at"), name.alias("name"))
    return df.select(message.alias("warning"), place.alias(ORDER))


# The texts of the warnings below.
def warnings(features: DataFrame, subjects: DataFrame, qc: DataFrame, least: int, high: float) -> DataFrame:
    """(warning): columns with much missing, small groups, failed records and key covariates that nothing holds, in this order."""
    none = F.lit("")
    much = features.filter(F.col("missing_rate") > high)
    small = group_sizes(subjects).filter(F.col("n") < least)
    fails = qc.filter("qc_status = 'fail'").agg(F.count("*").alias("n")).filter("n > 0")
    keys = [(i, k) for i, k in enumerate(KEY_COVARIATES) if k not in subjects.columns]
    lacking = features.sparkSession.createDataFrame(keys, "i long, key string").join(features.select(F.col("feature_name").alias("key")), "key", "left_anti")
    told = F.format_string
    return (
        _told(much, F.concat(F.lit("High missingness: "), "feature_name", F.lit(" ("), F.col("missing_rate").cast("string"), F.lit(")")), 0, F.col(ORDER), none)
        .unionByName(_told(small, told("Small group size: %s n=%d", "group", "n"), 1, F.lit(0), F.col("group")))
        .unionByName(_told(fails, told("QC failures present: %d records", "n"), 2, F.lit(0), none))
        .unionByName(_told(lacking, told("Missing key covariate: %s", "key"), 3, F.col("i"), none))
    )
