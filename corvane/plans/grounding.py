"""The grounding plan: papers to evidence, profiles, mapping, graph and report."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import evidence as ev
from corvane.operators import graph, profile, retrieval
from corvane.sources import sinks
from corvane.sources.files import size
from corvane.sources.readers import ORDER, Config, load_approved, load_confounds, load_literature, load_mapping_rules, read_csv
from corvane.staging import row_count, staged


@dataclass
class Grounding:
    """Tables of one run; those that several outputs are made from are written once."""

    config: Config
    papers: DataFrame
    hits: DataFrame | None
    evidence: DataFrame
    theoretical: DataFrame
    observed: DataFrame
    ready: DataFrame
    mapping: DataFrame
    nodes: DataFrame
    edges: DataFrame


def build(spark: SparkSession, config: Config) -> Grounding:
    papers = staged(load_literature(spark, config.primary_or_fixture(spark, "paths", "seed_papers", "fixture_seed_papers")), "grounding-papers", counted=True)
    search, hits = config.section("retrieval"), None
    if search.get("enabled", False):
        hits = staged(retrieval.retrieve(papers, str(search.get("query", "")), int(search.get("top_k", 20))), "grounding-hits", counted=True)
        papers = staged(retrieval.selected(papers, hits), "grounding-papers", counted=True)
    found = staged(ev.graded(ev.extracted(papers, default_population=config.section("evidence").get("default_population", ""))), "grounding-evidence", counted=True)
    given = lambda k: config.primary_or_fixture(spark, "paths", k, f"fixture_{k}")
    master_path = given("multimodal_master_table")
    master = read_csv(spark, master_path) if size(spark, master_path) >= 0 else spark.createDataFrame([], f"{ORDER} long")
    observed = staged(profile.observed_profile(read_csv(spark, given("feature_registry")), master, load_approved(given("approved_variables"), spark), master_path.rpartition("/")[2]), "grounding-observed")
    limits = config.section("data_profile")
    rules = profile.ReadyRules(float(limits.get("max_missing_rate", 0.4)), int(limits.get("min_n_available", 1)), tuple(map(str, limits.get("accepted_qc_status", ("pass", "usable")))))
    ready = staged(profile.analysis_ready(observed, rules), "grounding-ready", counted=True)
    mapping = staged(graph.mapped(found, ready, load_mapping_rules(config.path("paths", "variable_mapping_rules"), spark)), "grounding-mapping")
    templates = config.path("paths", "mechanism_templates")
    confounds = load_confounds(templates, spark) if size(spark, templates) >= 0 else []
    nodes, edges = graph.graph(papers, found, mapping, confounds)
    nodes, edges = staged(nodes, "grounding-nodes", counted=True), staged(edges, "grounding-edges", counted=True)
    return Grounding(config, papers, hits, found, profile.theoretical_profile(found), observed, ready, mapping, nodes, edges)


def report(run: Grounding) -> str:
    """Markdown of the run's figures; lists are of registry or rule size."""
    section = lambda title, lines: [f"## {title}", "", *lines, ""]
    quality = ev.quality_summary(run.evidence).first()
    directions = ev.direction_counts(run.evidence).orderBy(ORDER).collect()
    mapping = run.mapping.orderBy(ORDER).collect()
    confounds = run.nodes.filter("node_type = 'Confound'").select("label").distinct().orderBy("label").collect()
    ready = run.ready.orderBy(ORDER).collect()
    out = ["# Phase 1 Grounding Report", ""]
    out += section("Summary", [f"- Literature records: {row_count(run.papers)}", f"- Evidence records: {quality['n']}", f"- Mechanism graph nodes: {row_count(run.nodes)}", f"- Mechanism graph edges: {row_count(run.edges)}"])
    out += section("Evidence Direction Counts", [f"- {r['direction']}: {r['n']}" for r in directions])
    figures = [f"- {k}: {quality[c]:.3f}" for k, c in (("min", "lowest"), ("mean", "mean"), ("max", "highest"))] if quality["n"] else ["- no evidence"]
    out += section("Evidence Quality", figures)
    out += section("Analysis-Ready Variables", [f"- `{r['feature_name']}` ({r['modality']}, role={r['role']}, missing={r['missing_rate']})" for r in ready])
    of = lambda status: [r for r in mapping if r["mapping_status"] == status]
    # The headings.
    out += section("Unavailable But Theoretically Relevant Variables", [f"- `{r['concept']}` candidates={r['candidate_variables']}" for r in of("unavailable")])
    out += section("Ambiguous Mappings", [f"- `{r['concept']}` approved={r['approved_data_features']}" for r in of("ambiguous")])
    out += section("Main Confounds", [f"- {r['label']}" for r in confounds])
    places = [*[("output_grounding_dir", n) for n in ("evidence_table.csv", "evidence_table.json", "mechanism_graph_nodes.csv", "mechanism_graph_edges.csv", "mechanism_graph.json", "evidence_to_variable_map.yaml", "approved_variables_from_grounding.yaml")], *[("output_profiles_dir", f"{n}_profile.yaml") for n in ("theoretical", "observed", "analysis_ready")]]
    out += ["## Phase 2 Input Files", "", *[f"- `{run.config.path('paths', k)}/{n}`" for k, n in places], ""]
    return "\n".join(out)


def write(run: Grounding) -> dict[str, Any]:
    """All outputs at the configured places, and the run's figures."""
    at, profiles = run.config.path("paths", "output_grounding_dir"), run.config.path("paths", "output_profiles_dir")
    sinks.write_csv(run.evidence, f"{at}/evidence_table.csv")
    sinks.write_json(run.evidence, f"{at}/evidence_table.json")
    for name, df in (("theoretical", run.theoretical), ("observed", run.observed), ("analysis_ready", run.ready)):
        sinks.write_yaml({"profile_type": f"{name}_profile", "features": sinks.as_rows(df)}, f"{profiles}/{name}_profile.yaml")
    sinks.write_yaml({"mappings": sinks.as_rows(run.mapping)}, f"{at}/evidence_to_variable_map.yaml")
    names = [r["variable"] for r in graph.grounded_variables(run.mapping).collect()]
    sinks.write_yaml({"approved_variables": names}, f"{at}/approved_variables_from_grounding.yaml")
    sinks.write_csv(run.nodes, f"{at}/mechanism_graph_nodes.csv")
    sinks.write_csv(run.edges, f"{at}/mechanism_graph_edges.csv")
    sinks.write_json_document({"nodes": run.nodes, "edges": run.edges}, f"{at}/mechanism_graph.json")
    sinks.write_markdown(report(run), run.config.path("paths", "report_path"))
    return summary(run) | {"report_path": run.config.path("paths", "report_path"), "output_grounding_dir": at, "output_profiles_dir": profiles}


def summary(run: Grounding) -> dict[str, Any]:
    return {
        "papers": row_count(run.papers),
        "retrieval_hits": row_count(run.hits) if run.hits is not None else 0,
        "evidence": row_count(run.evidence),
        "analysis_ready_variables": row_count(run.ready),
        "graph_nodes": row_count(run.nodes),
        "graph_edges": row_count(run.edges),
    }
