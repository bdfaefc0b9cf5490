"""Both plans end to end on files written here, and the entry module."""

import json
import shutil

import pytest
import yaml

import __spark_entry__ as entry
from corvane import __main__ as cli
from corvane import staging
from corvane.operators import reporting
from corvane.plans import foundation, grounding
from corvane.sources import readers
from corvane.sources.readers import ORDER, Config

TABLES = {
    "subjects": "sub_id,group,age,sex\n A ,HC,30,F\nB,INS,NA,M\n,HC,1,F\n",
    "eeg": "subject_id,delta_power,age\nA,1.5,30\nB,,31\nC,2,9\n",
    "scales": "subject_id,ISI,medication\nA,4,none\nB,9,x\n",
    "qc": "subject_id,modality,qc_status\nA,EEG,pass\nA,scales,fail\nB,EEG,1\n",
    "papers": 'paper_id,title,abstract,keywords,notes\nk1,Delta waves,"A study reports increased delta power, in adults",sleep;EEG,Limitation: few\n,Other,nothing,,\n',
}
FOUNDATION = {
    "project": {"name": "Trial"},
    "inputs": {"subject_table": "in/subjects.csv", "eeg_features": "in/eeg.csv", "fmri_features": "in/none.csv", "scale_features": "in/scales.csv", "qc_summary": "in/qc.csv"},
    "outputs": {k: f"out/{k}" for k in ("subject_index", "feature_registry", "qc_summary", "multimodal_master_table")} | {"approved_variables": "out/approved.yaml", "data_dictionary": "out/dictionary.yaml", "report": "out/report.md"},
    "subject_id": {"column": "subject_id", "aliases": ["sub_id"]},
    "qc": {"pass_values": ["pass", "1"], "caution_values": [], "fail_values": ["fail", False]},
    "thresholds": {"max_missing_rate_primary": 0.2, "max_missing_rate_secondary": 0.35, "min_n_total": 2, "min_n_per_group": 2},
}
GROUNDING = {
    "paths": {
        "seed_papers": "in/none.csv", "fixture_seed_papers": "in/papers.csv", "feature_registry": "out/feature_registry", "fixture_feature_registry": "in/none.csv", "approved_variables": "out/approved.yaml",
        "fixture_approved_variables": "in/none.yaml", "multimodal_master_table": "out/multimodal_master_table", "fixture_multimodal_master_table": "in/none.csv", "mechanism_templates": "in/templates.yaml",
        "variable_mapping_rules": "in/rules.yaml", "output_grounding_dir": "out/grounding", "output_profiles_dir": "out/profiles", "report_path": "out/grounding.md",
    },
    "retrieval": {"enabled": True, "query": "delta", "top_k": 5},
    "data_profile": {"max_missing_rate": 0.4, "min_n_available": 2, "accepted_qc_status": ["pass"]},
    "evidence": {"default_population": "cohort"},
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("plans")
    (at / "in").mkdir()
    (at / "configs").mkdir()
    for name, content in TABLES.items():
        (at / "in" / f"{name}.csv").write_text(content)
    (at / "in" / "rules.yaml").write_text(yaml.safe_dump({"mappings": {"slow-wave generation": {"modality": "EEG", "candidates": ["delta_power", "gone"]}}}))
    (at / "in" / "templates.yaml").write_text(yaml.safe_dump({"confounds": ["age"]}))
    (at / "configs" / "f.yaml").write_text(yaml.safe_dump(FOUNDATION, sort_keys=False))
    (at / "configs" / "g.yaml").write_text(yaml.safe_dump(GROUNDING, sort_keys=False))
    return at


def test_foundation(spark, root):
    run = foundation.build(spark, Config.load(root / "configs" / "f.yaml"))
    rows = {r["subject_id"]: r for r in run.subjects.collect()}
    assert {k: (r["available_modalities"], r["overall_qc_status"], r["age"]) for k, r in rows.items()} == {"A": ("EEG;scales", "fail", 30.0), "B": ("EEG;scales", "pass", None)}
    master = run.master.orderBy(ORDER).drop(ORDER).collect()
    assert [r["subject_id"] for r in master] == ["A", "B", "C"]
    assert [r["EEG_age"] for r in master] == ["30", "31", ""] and master[2]["age"] == "9"
    assert foundation.merge_log(run)["modality_subject_coverage"] == {"EEG": 3, "fMRI": 0, "DTI": 0, "MRI": 0, "scales": 2}
    done = foundation.write(run)
    assert done["merge_log"]["duplicate_columns"] == [{"column": "age", "renamed_to": "EEG_age", "modality": "EEG", "n": 2}]
    assert (done["subject_count"], done["feature_count"], done["qc_record_count"], done["master_rows"]) == (2, 4, 3, 3)
    lists = yaml.safe_load((root / "out" / "approved.yaml").read_text())
    assert lists["EEG"] == ["delta_power"] and lists["covariates"] == ["age", "medication"] and lists["scales"] == ["ISI"]
    report = (root / "out" / "report.md").read_text()
    for line in ("- Total subjects: 2", "- EEG: 2", "- `delta_power` (EEG): 0.333", "- fail: 1", "- Rows: 3", "- Small group size: HC n=1", "- QC failures present: 1 records"):
        assert line in report


def test_grounding_and_command_line(spark, root, capsys):
    assert cli.main(["foundation", "build", "--config", str(root / "configs" / "f.yaml")]) == 0
    assert cli.main(["grounding", "build", "--config", str(root / "configs" / "g.yaml")]) == 0
    told = capsys.readouterr().out
    figures = json.loads(told[told.rindex('{\n  "papers"') :])
    assert (figures["papers"], figures["retrieval_hits"], figures["evidence"], figures["analysis_ready_variables"]) == (1, 1, 1, 4)
    run = grounding.build(spark, Config.load(root / "configs" / "g.yaml"))
    mapping = run.mapping.collect()
    assert [(r["concept"], r["mapping_status"], r["approved_data_features"]) for r in mapping] == [("slow-wave generation", "mapped", ["delta_power"])]
    bundle = json.loads("".join(p.read_text() for p in sorted((root / "out" / "grounding" / "mechanism_graph.json").glob("part-*"))))
    assert len(bundle["nodes"]) == figures["graph_nodes"] and len(bundle["edges"]) == figures["graph_edges"]
    assert bundle["nodes"][0]["node_id"] == "paper:k1" and set(bundle["edges"][0]) == {"source", "target", "edge_type", "weight", "metadata"}
    table = readers.read_records(spark, str(root / "out" / "grounding" / "evidence_table.json"))
    assert table.count() == 1 and table.first()["paper_id"] == "k1"
    assert yaml.safe_load((root / "out" / "grounding" / "approved_variables_from_grounding.yaml").read_text()) == {"approved_variables": ["delta_power"]}
    assert "- max: 0.980" in (root / "out" / "grounding.md").read_text()
    (root / "out" / "grounding.md").unlink()
    assert cli.main(["grounding", "report", "--config", str(root / "configs" / "g.yaml")]) == 0
    assert "- Mechanism graph edges: 6" in (root / "out" / "grounding.md").read_text()


def test_a_sixth_modality(spark, root):
    """A modality of one's own has its flag, coverage, list, report line and log."""
    (root / "in" / "pet.csv").write_text("subject_id,suv ratio,ISI\nB,1.2,3\nA,,4\nD,2,\n")
    config = Config(FOUNDATION | {"inputs": FOUNDATION["inputs"] | {"pet_features": "in/pet.csv"}, "thresholds": {"min_n_total": 1, "max_missing_rate_primary": 0.5}}, root)
    run = foundation.build(spark, config, {"EEG": "eeg_features", "PET-CT": "pet_features", "scales": "scale_features"})
    rows = {r["subject_id"]: r.asDict() for r in run.subjects.collect()}
    assert {k: (r["has_PET-CT"], r["available_modalities"]) for k, r in rows.items()} == {"A": (True, "EEG;PET-CT;scales"), "B": (True, "EEG;PET-CT;scales")}
    assert "has_fMRI" not in rows["A"]
    assert {r["bucket"]: r["names"] for r in run.buckets.collect()}["PET-CT"] == ["ISI", "suv ratio"]
    log = foundation.merge_log(run)
    assert log["modality_subject_coverage"] == {"EEG": 3, "PET-CT": 3, "scales": 2}
    assert [(x["renamed_to"], x["n"]) for x in log["duplicate_columns"]] == [("EEG_age", 2), ("scales_ISI", 1)]
    lines = foundation.report(run).splitlines()
    assert "- PET-CT: 2" in lines and "- PET-CT: 2" in lines[lines.index("## Feature Counts") :]
    told = {r["bucket"]: (r["n_subjects"], r["n_approved"]) for r in reporting.modality_summary(run.coverage, run.buckets).collect()}
    assert told["PET-CT"] == (3, 2) and told["covariates"] == (0, 2)


def test_plans_over_a_path_of_another_file_system(spark, root, tmp_path):
    """All sources and outputs under a scheme that only Hadoop's file systems open."""
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.plans.link./at", f"file://{tmp_path}")
    shutil.copytree(root / "in", tmp_path / "in")
    (tmp_path / "configs").mkdir()
    for name, content in (("f", FOUNDATION), ("g", GROUNDING)):
        (tmp_path / "configs" / f"{name}.yaml").write_text(yaml.safe_dump(content, sort_keys=False))
    base = "viewfs://plans/at"
    done = foundation.write(foundation.build(spark, Config.load(f"{base}/configs/f.yaml")))
    assert done["outputs"]["report"] == f"{base}/out/report.md" and "- Total subjects: 2" in (tmp_path / "out" / "report.md").read_text()
    assert readers.read_yaml(f"{base}/out/approved.yaml")["scales"] == ["ISI"]
    told = grounding.write(grounding.build(spark, Config.load(f"{base}/configs/g.yaml")))
    assert told["evidence"] == 1 and "- max: 0.980" in (tmp_path / "out" / "grounding.md").read_text()
    assert readers.load_approved(f"{base}/out/grounding/approved_variables_from_grounding.yaml") == ["delta_power"]
    assert readers.read_csv(spark, f"{base}/out/grounding/evidence_table.csv").count() == 1


def test_write_counts_while_it_writes(spark, root):
    """No job of write() reads a table only to count it: what it counts was counted when it was written."""
    run = foundation.build(spark, Config.load(root / "configs" / "f.yaml"))
    held = {"subjects": run.subjects, "qc": run.qc, "features": run.features, "master": run.master}
    assert {k: staging.row_count(df) for k, df in held.items()} == {"subjects": 2, "qc": 3, "features": 4, "master": 3}
    for df in held.values():
        df.count = lambda: pytest.fail("counted again")
    done = foundation.write(run)
    assert (done["subject_count"], done["master_rows"], done["merge_log"]["subject_count"]) == (2, 3, 3)


def test_missing_sources(spark, root):
    config = Config({"inputs": {"eeg_features": "in/eeg.csv"}}, root)
    run = foundation.build(spark, config)
    assert {r["subject_id"]: r["overall_qc_status"] for r in run.subjects.collect()} == {"A": "unknown", "B": "unknown", "C": "unknown"}
    assert {r["reason"] for r in run.qc.collect()} == {"QC file missing"}
    none = foundation.build(spark, Config({}, root))
    assert none.master.count() == 0 and none.features.count() == 0


def test_entry(spark, sf_dir):
    assert entry.entry(spark).columns[0] == "evidence_id"
    known = entry.queries()
    assert set(entry.oracle_sql()) <= set(known)
    assert known["entity_index"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()


PLAIN = ("missing_topk", "qc_counts_by_modality", "master_merge", "evidence_grade", "variable_map", "graph_edges", "keyword_retrieval", "tfidf_retrieval", "literature_normalize", "master_merge_found", "coverage_counts", "modality_summary", "csv_round_trip", "json_round_trip", "role_approval", "approved_totals", "foundation_warnings", "mapping_gaps")


@pytest.mark.parametrize("name", PLAIN)
def test_same_rows_as_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(text, r)) for r in cursor.fetchall())
    df = entry.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(map(text, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == want
