"""The foundation plan: source tables to index, quality records, registry, lists, dictionary, merged table and report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import entities, profile, reporting
from corvane.sources import sinks
from corvane.sources.files import size
from corvane.sources.readers import ORDER, Config, read_csv
from corvane.staging import row_count, staged

# The configuration's name of each modality's table, in order.
FEATURE_INPUTS = {"EEG": "eeg_features", "fMRI": "fmri_features", "DTI": "dti_features", "MRI": "mri_features", "scales": "scale_features"}
HIGH_MISSINGNESS = 0.35


@dataclass
class Foundation:
    """Tables of one run, each written once, and the log of its merge."""

    config: Config
    subjects: DataFrame
    qc: DataFrame
    features: DataFrame
    buckets: DataFrame
    dictionary: DataFrame
    master: DataFrame
    conflicts: DataFrame
    coverage: DataFrame
    modalities: tuple[str, ...]
    inputs: int


def key_names(config: Config) -> list[str]:
    given = config.section("subject_id")
    return [str(given.get("column", "subject_id")), *map(str, given.get("aliases", []))]


def thresholds(config: Config) -> profile.Thresholds:
    t = config.section("thresholds")
    return profile.Thresholds(float(t.get("max_missing_rate_primary", 0.35)), float(t.get("max_missing_rate_secondary", 0.35)), int(t.get("min_n_total", 1)))


def roles(config: Config) -> profile.Roles:
    """The configuration's roles, or those of old."""
    given = config.section("roles")
    return profile.Roles(**{k: tuple(map(str, v)) if isinstance(v, list) else str(v) for k, v in given.items()})


def _source(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return staged(entities.normalized(read_csv(spark, path, order="rising"), names), "foundation-source")


def build(spark: SparkSession, config: Config, inputs: Mapping[str, str] = FEATURE_INPUTS) -> Foundation:
    """All tables of the plan from the configured files, each read once.

    inputs: the configuration's name of each modality's table, in order. Any modality may be named: flags of the index,
    coverage, lists of approved columns, report and log follow the names given.
    """
    names = key_names(config)
    paths = {m: config.path("inputs", k) for m, k in inputs.items() if config.given("inputs", k)}
    paths = {m: p for m, p in paths.items() if size(spark, p) >= 0}
    tables = {m: (_source(spark, p, names), p) for m, p in paths.items()}
    at = config.path("inputs", "subject_table") if config.given("inputs", "subject_table") else None
    subjects = _source(spark, at, names) if at and size(spark, at) >= 0 else None
    words = config.section("qc")
    given = [list(words.get(f"{k}_values", [])) for k in ("pass", "caution", "fail")]
    path = config.path("inputs", "qc_summary") if config.given("inputs", "qc_summary") else None
    qc = entities.qc_records(read_csv(spark, path, order="rising"), *given, names) if path and size(spark, path) >= 0 else None
    return assembled(spark, config, subjects, tables, qc, tuple(inputs))


def assembled(spark: SparkSession, config: Config, subjects: DataFrame | None, tables: Mapping[str, tuple[DataFrame, str]], qc: DataFrame | None, modalities: Sequence[str] = entities.MODALITIES) -> Foundation:
    """The plan's tables from tables that are there: subjects, each modality's table with where it came from, and quality
    records. Each result that others are made from is written."""
    names = key_names(config)
    frames = {m: df for m, (df, _) in tables.items()}
    if subjects is None:
        # Without a table of subjects the first source stands in, and no other.
        subjects = next(iter(frames.values()), None)
    if subjects is None:
        subjects = spark.createDataFrame([], f"subject_id string, {ORDER} long")
    covered = entities.coverage(frames)
    if covered is None:
        covered = spark.createDataFrame([], "subject_id string, modality string")
    none = spark.createDataFrame([], "subject_id string, overall_qc_status string")
    qc = staged(qc, "foundation-qc", counted=True) if qc is not None else None
    covered = staged(covered, "foundation-coverage")
    index = staged(entities.index(subjects, covered, entities.overall_status(qc) if qc is not None else none, modalities), "foundation-index", counted=True)
    if qc is None or not row_count(qc):
        qc = staged(entities.unknown_qc(index), "foundation-qc", counted=True)
    features = profile.registry(dict(tables), names, roles(config))
    if features is None:
        features = profile.registry({"EEG": (spark.createDataFrame([], f"subject_id string, x string, {ORDER} long"), "")}, names)
    features = staged(profile.approved(features, thresholds(config)), "foundation-registry", counted=True)
    master, conflicts = entities.merged(index, frames)
    master, conflicts = staged(master, "foundation-master", counted=True), staged(conflicts, "foundation-conflicts")
    return Foundation(config, index, qc, features, profile.approved_buckets(features, modalities), profile.dictionary(features), master, conflicts, covered, tuple(modalities), len(tables))


def warnings(run: Foundation) -> list[str]:
    least = int(run.config.section("thresholds").get("min_n_per_group", 1))
    told = reporting.warnings(run.features, run.subjects, run.qc, least, HIGH_MISSINGNESS)
    return [r["warning"] for r in told.orderBy(ORDER).collect()]


def report(run: Foundation, now: datetime | None = None) -> str:
    """Markdown of the run's figures; only aggregates reach the driver."""
    subjects = run.subjects.agg(F.count("*").alias("n"), *[F.count_if(F.col("group") == g).alias(g) for g in profile.GROUPS], *[F.count_if(f"`has_{m}`").alias(m) for m in run.modalities]).first()
    by_modality = reporting.feature_counts(run.features).collect()
    status = {r["qc_status"]: r["n"] for r in reporting.qc_histogram(run.qc).collect()}
    lists = [(r["bucket"], r["n"]) for r in reporting.approved_totals(run.buckets).orderBy(ORDER).collect()]
    top = profile.most_missing(run.features).select("feature_name", "modality", "missing_rate").collect()
    # The headings and names of figures.
    section = lambda title, lines: [f"## {title}", "", *lines, ""]
    item = lambda k, v: f"- {k}: {v}"
    out = ["# Data Foundation Report", "", item("Project", run.config.section("project").get("name", "")), item("Run time", (now or datetime.now()).isoformat(timespec="seconds")), ""]
    out += section("Inputs", [item(k, f"`{v}`") for k, v in run.config.section("inputs").items()])
    out += section("Subjects", [item("Total subjects", subjects["n"]), *[item(g, subjects[g]) for g in profile.GROUPS]])
    out += section("Modality Coverage", [item(m, subjects[m]) for m in run.modalities])
    out += section("Feature Counts", [item(r["modality"], r["n"]) for r in by_modality])
    out += section("Highest Missingness Variables", [f"- `{r['feature_name']}` ({r['modality']}): {r['missing_rate']}" for r in top])
    out += section("Approved Variables", [item("Total approved variables", sum(n for _, n in lists)), *[item(k, n) for k, n in lists]])
    out += section("QC Summary", [item(k, status.get(k, 0)) for k in reporting.STATUS_ORDER])
    rows = row_count(run.master)
    out += section("Multimodal Master Table", [item("Rows", rows), item("Columns", len(run.master.columns) - 1 if rows else 0), item("Input files", run.inputs)])
    artifacts = ("subject_index.csv", "feature_registry.csv", "approved_variables.yaml", "data_dictionary.yaml", "qc_summary.csv", "multimodal_master_table.csv")
    out += section("Knowledge Grounding Inputs", [f"- `data/foundation/{a}`" for a in artifacts])
    out += ["## Warnings", "", *([f"- {w}" for w in warnings(run)] or ["- None"])]
    return "\n".join(out) + "\n"


def summary(run: Foundation) -> dict[str, Any]:
    rows = row_count(run.master)
    return {"subject_count": row_count(run.subjects), "feature_count": row_count(run.features), "qc_record_count": row_count(run.qc), "master_rows": rows, "master_columns": len(run.master.columns) - 1 if rows else 0}


def merge_log(run: Foundation) -> dict[str, Any]:
    by = {r["modality"]: r["n"] for r in reporting.coverage_counts(run.coverage).collect()}
    return {
        "input_file_count": run.inputs,
        "subject_count": row_count(run.master),
        "modality_subject_coverage": {m: by.get(m, 0) for m in run.modalities},
        "merged_column_count": len(run.master.columns) - 1,
        "duplicate_columns": [r.asDict() for r in run.conflicts.orderBy("modality", "column").collect()],
    }


def write(run: Foundation) -> dict[str, Any]:
    """All outputs at the configured places, and the run's figures."""
    at = lambda k: run.config.path("outputs", k)
    sinks.write_csv(run.subjects, at("subject_index"))
    sinks.write_csv(run.qc, at("qc_summary"))
    sinks.write_csv(run.features, at("feature_registry"))
    sinks.write_yaml({r["bucket"]: r["names"] for r in run.buckets.orderBy(ORDER).collect()}, at("approved_variables"))
    sinks.write_yaml({"variables": sinks.as_rows(run.dictionary)}, at("data_dictionary"))
    sinks.write_csv(run.master, at("multimodal_master_table"))
    sinks.write_markdown(report(run), at("report"))
    return summary(run) | {"merge_log": merge_log(run), "outputs": {k: at(k) for k in ("subject_index", "feature_registry", "approved_variables", "data_dictionary", "qc_summary", "multimodal_master_table", "report")}}
