"""Operators on small tables, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from corvane import staging
from corvane.functions import text as fn
from corvane.operators import entities, evidence, graph, graphstore, profile, retrieval, textindex
from corvane.sources import files, readers, sinks
from corvane.sources.readers import ORDER


def frame(spark, rows, schema):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{schema}, {ORDER} long")


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_missing_rate_rounds_like_python(spark):
    r = random.Random(1)
    pairs = [(3, 80), (7, 16), (0, 1), (1, 1), (0, 0)] + [(r.randint(0, t), t) for t in (r.randint(1, 2000) for _ in range(4000))]
    got = spark.createDataFrame(pairs, "a long, t long").select(fn.missing_rate(F.col("a"), F.col("t"))).collect()
    assert [x[0] for x in got] == [round(1 - a / (t or 1), 3) for a, t in pairs]


def test_text_functions(spark):
    assert column(spark, [" a\t", " b\n", None, " c  d "], fn.strip) == ["a", "b", "", "c  d"]
    assert column(spark, [" c \n d "], fn.collapse) == ["c d"]
    assert column(spark, ["a; b |,c", "", None], fn.split_keywords) == [["a", "b", "c"], [], []]
    assert column(spark, ["EEG-fMRI_2 café!"], fn.tokens) == [["eeg-fmri_2", "caf"]]
    missing = ["", "NA", "N/A", "nan", "NaN", "None", "null", " ", "none", "0", None]
    assert column(spark, missing, fn.is_missing) == [True, True, True, True, False, True, True, True, False, False, True]
    assert column(spark, missing, lambda c: fn.is_missing(c, fn.MASTER_MISSING)) == [True, True, False, True, False, True, False, True, False, False, True]

    def number(v):
        try:
            float(v)
            return True
        except ValueError:
            return False

    cells = ["1e5", " 12 ", "inf", "1d", "1_000", "1__0", ".5", "5.", ".", "-1.5E-3", "nan", "x", "0x1", "1f"]
    assert column(spark, cells, fn.is_number) == [number(v) for v in cells]
    assert column(spark, ["Yes", " approved ", "no", None, "1"], fn.is_truthy) == [True, True, False, False, True]
    ids = spark.range(1).select(fn.stable_id("evidence", F.lit("p"), F.lit(None), F.lit("v"))).first()[0]
    import hashlib

    assert ids == "evidence_" + hashlib.sha1(b"p||||v").hexdigest()[:12]


def test_key_by_alias_and_empty_keys(spark):
    df = entities.normalized(frame(spark, [(" a ", "1"), ("", "2"), (None, "3")], "sub_id string, v string"))
    assert [tuple(r)[:2] for r in df.select("subject_id", "v").collect()] == [("a", "1")]
    with pytest.raises(ValueError):
        entities.normalized(frame(spark, [("a",)], "name string"))


def test_qc_words_are_exact(spark):
    values = ["pass", "PASS", "Pass", "true", "True", "1", "0", "false", "False", "partial", "CAUTION", " fail ", None]
    got = column(spark, values, lambda c: entities.normalized_status(c, ["pass", "PASS", "ok", True, "1"], ["caution", "partial"], ["fail", False, "0"]))
    assert got == ["pass", "pass", "unknown", "unknown", "pass", "pass", "fail", "unknown", "fail", "caution", "unknown", "fail", "unknown"]


def test_index(spark):
    subjects = entities.normalized(frame(spark, [("a", "HC", "34"), ("b", "INS", "NA"), ("a", "HC", "35")], "subject_id string, group string, age string"))
    tables = {"EEG": frame(spark, [("a",), ("a",)], "subject_id string"), "scales": frame(spark, [("b",), ("a",)], "subject_id string")}
    qc = entities.qc_records(frame(spark, [("a", "fail"), ("a", "pass"), ("c", "pass")], "subject_id string, qc_status string"), ["pass"], [], ["fail"])
    rows = entities.index(subjects, entities.coverage(tables), entities.overall_status(qc)).orderBy(ORDER).collect()
    assert [(r["subject_id"], r["age"], r["has_EEG"], r["has_DTI"], r["available_modalities"], r["overall_qc_status"]) for r in rows] == [
        ("a", 34.0, True, False, "EEG;scales", "fail"), ("b", None, False, False, "scales", "unknown"), ("a", 35.0, True, False, "EEG;scales", "fail")
    ]
    unknown = entities.unknown_qc(subjects).collect()
    assert {(r["modality"], r["qc_status"], r["reason"]) for r in unknown} == {("all", "unknown", "QC file missing")}


def folded(subjects, tables):
    """The merge, one cell after the other."""
    out, log = {}, {}
    for r in subjects:
        out[r["subject_id"]] = dict(r)
    for m, rows in tables.items():
        for r in rows:
            target = out.setdefault(r["subject_id"], {"subject_id": r["subject_id"]})
            for c, v in r.items():
                if c not in target:
                    target[c] = v
                elif target[c] != v and v != "":
                    target[f"{m}_{c}"] = v
                    log[(c, m)] = log.get((c, m), 0) + 1
    return out, log


@pytest.mark.parametrize("seed", range(4))
def test_merge_is_first_writer_wins(spark, seed):
    r = random.Random(seed)
    cell = lambda: r.choice(["", "1", "2", "3"])
    make = lambda n, columns: [{"subject_id": r.choice("abcdef"), **{c: cell() for c in columns}} for _ in range(n)]
    subjects, tables = make(5, ["x", "g"]), {"EEG": make(7, ["x", "y"]), "fMRI": make(6, ["y", "z", "g"]), "MRI": []}
    df = lambda rows, columns: frame(spark, [tuple(q[c] for c in ["subject_id", *columns]) for q in rows], ", ".join(f"{c} string" for c in ["subject_id", *columns]))
    frames = {"EEG": df(tables["EEG"], ["x", "y"]), "fMRI": df(tables["fMRI"], ["y", "z", "g"]), "MRI": df([], ["z"])}
    merged, log = entities.merged(df(subjects, ["x", "g"]), frames)
    want, renamed = folded(subjects, tables)
    got = merged.orderBy(ORDER).drop(ORDER).collect()
    columns = list(dict.fromkeys(k for v in want.values() for k in v))
    assert set(got[0].asDict()) == set(columns)
    assert [q["subject_id"] for q in got] == list(want)
    for q in got:
        assert q.asDict() == {c: want[q["subject_id"]].get(c, "") for c in columns}
    assert {(q["column"], q["modality"]): q["n"] for q in log.collect()} == renamed


def test_merge_of_a_hot_subject(spark):
    """A subject with 100,000 rows of a table: combined before the one shuffle, and exact where its values are many."""
    n = 100_000
    subjects = frame(spark, [("hot", "5"), ("b", "1")], "subject_id string, x string")
    many = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 100 == 7, F.lit("b")).otherwise(F.lit("hot")).alias("subject_id"), F.when(F.col("id") % 3 == 0, F.lit("")).otherwise((F.col("id") % 11).cast("string")).alias("x"), F.lit("w").alias("y"), F.col("id").alias(ORDER))
    merged, log = entities.merged(subjects, {"EEG": many})
    want, renamed = folded([{"subject_id": "hot", "x": "5"}, {"subject_id": "b", "x": "1"}], {"EEG": [r.asDict() for r in many.drop(ORDER).orderBy(F.monotonically_increasing_id()).collect()]})
    assert {r["subject_id"]: r.asDict() for r in merged.drop(ORDER).collect()} == {k: {c: v.get(c, "") for c in ("subject_id", "x", "y", "EEG_x")} for k, v in want.items()}
    assert {(r["column"], r["modality"]): r["n"] for r in log.collect()} == renamed
    stack, names, within = entities._stacked(subjects, {"EEG": many})
    plan = entities.cells(stack, names, ["x"], within)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and plan.index("partial_min_by") > plan.index("Exchange hashpartitioning")


def test_merge_without_several_values_has_no_join(spark):
    subjects = frame(spark, [("a", "1"), ("b", "")], "subject_id string, x string")
    merged, log = entities.merged(subjects, {"EEG": frame(spark, [("a", "2"), ("c", "3"), ("b", "4")], "subject_id string, x string")}, conflicts="all")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan
    assert {tuple(r) for r in merged.drop(ORDER).collect()} == {("a", "1", "2"), ("b", "", "4"), ("c", "3", "")}
    assert [r["n"] for r in log.collect()] == [2]


def test_merge_refuses_names_that_conflicts_take(spark):
    with pytest.raises(ValueError):
        entities.merged(frame(spark, [("a", "1")], "subject_id string, EEG_x string"), {"EEG": frame(spark, [("a", "1")], "subject_id string, x string")})


def test_registry_and_approval(spark):
    rows = [("a", "1", "x", "", "1"), ("b", "", "y", "", "2"), ("c", "3", "1", "NA", "q")]
    df = frame(spark, rows, "subject_id string, ISI string, group string, qc_x string, FA string")
    found = {r["feature_name"]: r for r in profile.registry({"DTI": (df, "f.csv")}).collect()}
    assert [(n, found[n]["role"], found[n]["dtype"], found[n]["missing_rate"], found[n]["n_available"]) for n in ("ISI", "group", "qc_x", "FA")] == [
        ("ISI", "outcome", "numeric", 0.333, 2), ("group", "group", "categorical", 0.0, 3), ("qc_x", "qc", "unknown", 1.0, 0), ("FA", "feature", "categorical", 0.0, 3)
    ]
    cases = [("outcome", 0.2, 5), ("outcome", 0.201, 5), ("feature", 0.35, 5), ("feature", 0.351, 5), ("feature", 0.0, 1), ("feature", 0.0, 2), ("feature", None, None)]
    got = profile.approved(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, role string, missing_rate double, n_available long"), profile.Thresholds(0.2, 0.35, 2)).orderBy("i").collect()
    assert [r["approved"] for r in got] == [True, False, True, False, False, True, True]
    assert got[1]["approval_reason"] == "missing_rate>0.2" and got[4]["approval_reason"] == "n_available<2"
    buckets = {r["bucket"]: r["names"] for r in profile.approved_buckets(profile.approved(profile.registry({"DTI": (df, "f")}), profile.Thresholds(0.4, 0.4, 1))).collect()}
    assert buckets == {"DTI": ["FA", "ISI"], "group": ["group"], "EEG": [], "fMRI": [], "MRI": [], "scales": [], "covariates": [], "qc": []}
    own = profile.Roles(group="arm", covariates=("FA",), outcomes=("qc_x",), scales=("ISI",), qc_prefix="gr")
    assert {r["feature_name"]: r["role"] for r in profile.registry({"DTI": (df, "f")}, roles=own).collect()} == {"ISI": "scale", "group": "qc", "qc_x": "outcome", "FA": "covariate"}
    words = {r["variable"]: r["allowed_values"] for r in profile.dictionary(profile.registry({"DTI": (df, "f")})).collect()}
    assert words["group"] == ["HC", "INS"] and words["FA"] == []
    assert [r["feature_name"] for r in profile.most_missing(profile.registry({"DTI": (df, "f")}), 3).collect()] == ["qc_x", "ISI", "group"]


def test_five_thousand_columns_in_one_pass(spark, tmp_path):
    r = random.Random(9)
    names = [f"c {i}" for i in range(5000)]
    rows = [[r.choice(["", "NA", "1", " 2.5 ", "x", "1e3"]) if i % 3 else r.choice(["7", ""]) for i in range(5000)] for _ in range(40)]
    (tmp_path / "wide.csv").write_text(",".join(["subject_id", *names]) + "\n" + "".join(",".join([f"s{k}", *q]) + "\n" for k, q in enumerate(rows)))
    wide = entities.normalized(readers.read_csv(spark, str(tmp_path / "wide.csv")))
    found = profile.registry({"EEG": (wide, "wide.csv")})
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and plan.count("count(") < 10
    got = {q["feature_name"]: q for q in found.collect()}
    assert list(got) and len(got) == 5000
    for i in list(range(0, 5000, 97)) + [4999]:
        cells = [q[i].strip() for q in rows]
        there = [v for v in cells if v not in ("", "NA")]
        kind = "unknown" if not there else "numeric" if "x" not in there else "categorical"
        assert (got[names[i]]["n_available"], got[names[i]]["dtype"], got[names[i]]["missing_rate"]) == (len(there), kind, round(1 - len(there) / 40, 3))


PAPERS = [
    ("p1", "Showcase", "Slow wave activity was not associated with a decision.", ["EEG"], "Limitation: small n ", ""),
    ("p2", "Review", "Opposite findings for the DMN", [], "", "journal"),
    ("p3", "FA first", "in adults, DTI", ["MRI"], "small sample", "x"),
    ("p2", "Second of one id", "nothing", [], "", ""),
]


def papers(spark):
    return frame(spark, PAPERS, "paper_id string, title string, abstract string, keywords array<string>, notes string, source string")


def test_evidence(spark):
    rows = evidence.graded(evidence.extracted(papers(spark), default_population="cohort")).orderBy(ORDER).collect()
    got = [(r["paper_id"], r["variable_or_feature"], r["direction"], r["evidence_type"], r["population"], r["limitation"]) for r in rows]
    assert got == [
        ("p1", "slow_wave_density", "null", "case", "cohort", "small n"),
        ("p1", "ISI", "null", "case", "cohort", "small n"),
        ("p2", "thalamus_DMN_FC", "refute", "review", "cohort", ""),
        ("p3", "FA", "unclear", "unknown", "adults", "small sample"),
        ("p3", "FA", "unclear", "unknown", "adults", "small sample"),
        ("p3", "MRI", "unclear", "unknown", "adults", "small sample"),
    ]
    assert [r["evidence_quality_score"] for r in rows] == [0.53, 0.53, 0.9, 0.35, 0.35, 0.35]
    assert rows[3]["evidence_id"] == rows[4]["evidence_id"]
    assert {r["direction"]: r["n"] for r in evidence.direction_counts(evidence.extracted(papers(spark))).collect()} == {"support": 0, "refute": 1, "null": 2, "unclear": 3}
    assert evidence.quality_summary(evidence.graded(evidence.extracted(papers(spark).limit(0)))).first()["n"] == 0


def test_ten_thousand_rules_as_a_table(spark, monkeypatch):
    """The same rows as looking for every keyword in every text, with one pass over the texts and none of them shuffled."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(3, 7)))
    keywords = [word() for _ in range(9990)] + ["", "a", "eé", None, " ", "😀😀", "zzzz not there", "abc", "abc", "x" * 40000]
    rules = [(k, f"m{i % 5}", f"v{i}", None if i == 3 else f"c{i % 7}", i) for i, k in enumerate(keywords)]
    texts = ["".join(r.choice("abcdeé  ") for _ in range(r.randint(0, 400))) for _ in range(60)] + ["", "A", "ABC", "x" * 50000, "ab " * 12000 + "😀😀 Eé", None]
    docs = frame(spark, [(f"d{i}", t, "", [], "", "") for i, t in enumerate(texts)], "paper_id string, title string, abstract string, keywords array<string>, notes string, source string")
    table = spark.createDataFrame(rules, f"keyword string, modality string, variable string, mechanism string, {ORDER} long")
    want = {(f"d{i}", v) for i, t in enumerate(texts) for k, _, v, _, _ in rules if k is not None and k in f" {(t or '').lower()}    "}
    found = evidence.extracted(docs, table)
    got = [(q["paper_id"], q["variable_or_feature"]) for q in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(evidence, "SENT", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert {(q["paper_id"], q["variable_or_feature"]) for q in evidence.extracted(docs, table).collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    few = [evidence.Rule(*q[:4]) for q in rules[:40] if q[0] is not None and q[3]]
    listed = spark.createDataFrame([(*q, i) for i, q in enumerate(few)], f"keyword string, modality string, variable string, mechanism string, {ORDER} long")
    rows = lambda df: [tuple(q) for q in df.orderBy(ORDER).drop(ORDER).collect()]
    assert rows(evidence.extracted(docs, few)) == rows(evidence.extracted(docs, listed))
    assert evidence.extracted(docs, table.limit(0)).isEmpty()


def test_retrieval(spark):
    docs = frame(spark, [(f"d{i}", t, "", [], "", "") for i, t in enumerate(["sleep sleep wave", "wave", "other", "sleep wave", "wave"])], "paper_id string, title string, abstract string, keywords array<string>, notes string, source string")
    hits = retrieval.keyword_retrieve(docs, " Sleep wave ", 4).collect()
    assert [(r["paper_id"], r["score"]) for r in hits] == [("d0", 3.0), ("d3", 2.0), ("d1", 1.0), ("d4", 1.0)]
    assert hits[0]["source"] == "literature"
    best = retrieval.tfidf_retrieve(docs, "sleep wave", 2).collect()
    assert best[0]["paper_id"] == "d3" and best[0]["score"] == 1.0
    assert retrieval.retrieve(docs, "nothing here", 3).isEmpty() and retrieval.tfidf_retrieve(docs, "nothing here", 3).isEmpty()
    many = spark.createDataFrame([(7, "sleep wave"), (8, "other"), (9, None), (10, "none of these")], "query_id long, query string")
    got = {(r["query_id"], r["paper_id"], r["score"]) for r in retrieval.keyword_retrieve(docs, many, 2).collect()}
    assert got == {(7, "d0", 3.0), (7, "d3", 2.0), (8, "d2", 1.0)}
    got = {(r["query_id"], r["paper_id"], r["score"]) for r in retrieval.tfidf_retrieve(docs, many, 1).collect()}
    assert got == {(7, "d3", 1.0), (8, "d2", 1.0)}
    with pytest.raises(ValueError):
        retrieval.retrieve(docs, "sleep", -1)
    assert [r["paper_id"] for r in retrieval.selected(docs, retrieval.retrieve(docs, "sleep", 9)).orderBy(ORDER).collect()] == ["d0", "d3"]


def test_stored_index(spark, tmp_path):
    """The same rows as searching the texts; a second search reads neither them nor other tokens' buckets."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(200)] + ["Sleep", "é"]
    texts = [" ".join(r.choice(words[: r.choice([5, 50, 202])]) for _ in range(r.randint(0, 60))) for _ in range(150)] + [None, "", "sleep " * 3000]
    docs = frame(spark, [(f"d{i}", t, "", [], "", "x" if i % 2 else "") for i, t in enumerate(texts)], "paper_id string, title string, abstract string, keywords array<string>, notes string, source string")
    at = tmp_path / "papers"
    docs.write.parquet(str(at))
    index = textindex.TextIndex.build(spark.read.parquet(str(at)), str(tmp_path / "index"), buckets=8)
    held = {q[0]: q[1] for q in index.postings.groupBy(ORDER).agg(F.sum("tf")).collect()}
    assert held == {i: len(re.findall(r"[A-Za-z0-9_\-]+", t)) for i, t in enumerate(texts) if t}
    many = spark.createDataFrame([(1, "w1 w2 w2 sleep"), (2, "w150 gone"), (3, None), (4, "nothing here")], "query_id long, query string")
    rows = lambda df: sorted(tuple(q) for q in df.collect())
    import shutil

    want = [rows(f(docs, q, 12)) for f in (retrieval.keyword_retrieve, retrieval.tfidf_retrieve) for q in (many, "w3 Sleep")]
    shutil.rmtree(at)
    again = textindex.TextIndex.open(spark, str(tmp_path / "index"))
    assert [rows(f(q, 12)) for f in (again.keyword, again.tfidf) for q in (many, "w3 Sleep")] == want
    assert [x["paper_id"] for x in again.keyword("w3 sleep", 3).collect()] == [x["paper_id"] for x in retrieval.keyword_retrieve(docs, "w3 sleep", 3).collect()]
    plan = again.postings.filter(F.col("bucket").isin([3])).select("token")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan or "bucket" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert textindex.TextIndex.there(spark, str(tmp_path / "index")) and not textindex.TextIndex.there(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        again.tfidf("x", -1)
    none = textindex.TextIndex.build(docs.limit(0), str(tmp_path / "index"))
    assert none.total == 0 and none.keyword("w1", 3).isEmpty() and none.tfidf("w1", 3).isEmpty()


def test_stored_index_deals_postings_once(spark, tmp_path):
    """A common token's rows lie in several files, norms by paper, and no setting of the session stays changed."""
    docs = frame(spark, [(f"d{i}", f"sleep W{i % 7} w{i % 7}", "", [], "", "") for i in range(60)], "paper_id string, title string, abstract string, keywords array<string>, notes string, source string")
    key, joined = "spark.sql.maxConcurrentOutputFileWriters", "spark.sql.adaptive.coalescePartitions.enabled"
    before, piece = spark.conf.get(key, "0"), textindex.PIECE
    try:
        textindex.PIECE = 8
        spark.conf.set(joined, "false")
        index = textindex.TextIndex.build(docs, str(tmp_path / "index"), buckets=4)
    finally:
        textindex.PIECE = piece
        spark.conf.unset(joined)
    assert spark.conf.get(key, "0") == before
    assert index.postings.filter("token = 'sleep'").select("_metadata.file_path").distinct().count() > 1
    assert {(r["token"], r["tf"]) for r in index.postings.collect()} == {("sleep", 1), *((f"w{i}", 2) for i in range(7))}
    assert index.norms.count() == 60 and "norm" not in index.postings.columns
    for q in ("w3 sleep", "w6"):
        assert [tuple(r) for r in index.tfidf(q, 12).collect()] == [tuple(r) for r in retrieval.tfidf_retrieve(docs, q, 12).collect()]


def test_texts_are_searched_once(spark, tmp_path):
    """A rule's keyword stands once in the plan; files' block numbers come to the rows; the trim of long texts is the trim."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(evidence.extracted(papers(spark))).count("hyperarousal)") == 1
    spark.range(40, numPartitions=3).select("id").write.option("header", True).csv(str(tmp_path / "t"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = readers.read_csv(spark, str(tmp_path / "t"))
        assert "SortMergeJoin" not in plan(rows) and [r["id"] for r in rows.orderBy(ORDER).collect()] == [str(i) for i in range(40)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    odd = [None, "", " ", "x", " x", "x\n", "\u2003x y\u0085", "\U0001f600 ", "\U0001f600", "a\r\n", "\u200bx", "x \u2028"]
    told = spark.createDataFrame([(x,) for x in odd], "x string").select(fn.strip(F.col("x")), fn.strip_long(F.col("x"))).collect()
    assert all(a == b for a, b in told) and [b for _, b in told][4:6] == ["x", "x"]


def test_mapping_and_graph(spark):
    found = evidence.graded(evidence.extracted(papers(spark)))
    ready = spark.createDataFrame([("FA",), ("cingulum_FA",), ("delta_power",)], "feature_name string")
    rules = [("slow-wave generation", "EEG", ["slow_wave_density", "delta_power"]), ("white matter integrity", "DTI", ["cingulum_FA", "x", "FA"])]
    mapping = graph.mapped(found, ready, rules)
    got = [(r["concept"], r["approved_data_features"], r["mapping_status"], r["mapping_confidence"]) for r in mapping.orderBy(ORDER).collect()]
    assert got == [
        ("slow-wave generation", ["delta_power"], "mapped", 0.9),
        ("insomnia severity", [], "unavailable", 0.0),
        ("thalamocortical coupling", [], "unavailable", 0.0),
        ("white matter integrity", ["cingulum_FA", "FA"], "ambiguous", 0.65),
        ("structural morphology", [], "unavailable", 0.0),
    ]
    assert [r[0] for r in graph.grounded_variables(mapping).collect()] == ["FA", "cingulum_FA", "delta_power"]
    nodes, edges = graph.graph(papers(spark), found, mapping, ["age", "sex"])
    nodes, edges = nodes.orderBy(ORDER).collect(), edges.orderBy(ORDER).collect()
    assert [n["node_id"] for n in nodes[:3]] == ["paper:p1", f"finding:{found.orderBy(ORDER).first()['evidence_id']}", "mechanism:slow-wave generation"]
    assert next(n["label"] for n in nodes if n["node_id"] == "paper:p2") == "Second of one id"
    variables = [n["node_id"] for n in nodes if n["node_type"] == "Variable"]
    assert len(edges) == 4 * 6 + 3 + 2 * len(variables)
    assert [(e["source"], e["target"]) for e in edges[-len(variables) :]] == [("confound:sex", v) for v in variables]
    assert len(nodes) == len({n["node_id"] for n in nodes})


def test_batches_give_the_graph_of_all(spark, tmp_path):
    """Two batches against both at once; the stored side isn't shuffled, and what a failed batch left doesn't count."""
    ready = spark.createDataFrame([("FA",), ("cingulum_FA",), ("delta_power",)], "feature_name string")
    rules = [("slow-wave generation", "EEG", ["slow_wave_density", "delta_power"]), ("white matter integrity", "DTI", ["cingulum_FA", "x", "FA"])]
    more = frame(spark, [("q1", "Delta", "slow wave and DTI increased", [], "", ""), ("q2", "Beta", "refute hyperarousal", [], "", "")], "paper_id string, title string, abstract string, keywords array<string>, notes string, source string").withColumn(ORDER, F.col(ORDER) + 100)
    both = papers(spark).unionByName(more)
    of = lambda docs: staging.staged(evidence.graded(evidence.extracted(docs)), "evidence")
    whole = of(both)
    nodes, edges = graph.graph(both, whole, graph.mapped(whole, ready, rules), ["age", "sex"])
    rows = lambda df, *c: sorted(str(tuple(r)) for r in df.select(*c).collect())
    node_columns, edge_columns = ("node_id", "label", "node_type", F.to_json("metadata")), ("source", "target", "edge_type", "weight")
    at = str(tmp_path / "graph")
    store = graphstore.GraphStore.open(spark, at, ["age", "sex"], buckets=4)
    assert store.edges().isEmpty() and store.nodes().isEmpty()
    first = of(papers(spark))
    store.add(papers(spark), first, graph.mapped(first, ready, rules))
    spark.range(3).write.parquet(f"{at}/edges/batch=1")
    again = graphstore.GraphStore.open(spark, at)
    second = of(more)
    again.add(more, second, graph.mapped(second, ready, rules))
    last = graphstore.GraphStore.open(spark, at)
    assert (last.batches, last.confounds) == (2, ("age", "sex"))
    assert rows(last.nodes(), *node_columns) == rows(nodes, *node_columns)
    assert rows(last.edges(), *edge_columns) == rows(edges, *edge_columns)
    assert [r["node_id"] for r in last.nodes().orderBy(ORDER).limit(2).collect()] == [r["node_id"] for r in nodes.orderBy(ORDER).limit(2).collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = last.fresh(nodes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Bucketed: true" in plan and "LeftAnti" in plan
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    assert "Exchange" not in "".join(lines[scan - 4 : scan + 1])


def test_profiles(spark):
    records = frame(spark, [("a", "EEG", "a", "true"), ("b", "EEG", "", "no"), ("c", "EEG", "zz", "no")], "feature_name string, modality string, source_column string, approved string")
    master = frame(spark, [("1", "N/A"), ("", "2"), ("None", "3")], "a string, b string")
    rows = profile.observed_profile(records, master, ["c"], "m.csv")
    assert [(r["source_column"], r["missing_rate"], r["n_available"], r["approved"], r["source_file"]) for r in rows.orderBy(ORDER).collect()] == [
        ("a", 0.667, 1, True, "m.csv"), ("b", 0.0, 3, False, "m.csv"), ("zz", None, None, True, "m.csv")
    ]
    assert [r["feature_name"] for r in profile.analysis_ready(rows).orderBy(ORDER).collect()] == ["c"]
    need = profile.theoretical_profile(evidence.extracted(papers(spark))).orderBy(ORDER).collect()
    assert [r["feature_name"] for r in need] == ["slow_wave_density", "ISI", "thalamus_DMN_FC", "FA", "MRI"]


def test_paper_ids_tell_the_year_that_was_read(spark):
    """Ids written down from the rule: SHA-1 of title, abstract and the parsed year, none and zero being empty."""
    import hashlib

    cells = {"2022.0": "", "02020": "2020", "0": "", "": "", " 1999 ": "1999", "000": "", "12x": "", None: "", "99999999999999999999": "99999999999999999999"}
    rows = spark.createDataFrame([("", "t", "a", y, i) for i, y in enumerate(cells)], f"paper_id string, title string, abstract string, year string, {ORDER} long")
    got = readers.normalize_literature(rows).orderBy(ORDER).collect()
    assert [r["paper_id"] for r in got] == ["paper_" + hashlib.sha1(f"t||a||{y}".encode()).hexdigest()[:12] for y in cells.values()]
    assert [r["year"] for r in got] == [None, 2020, 0, None, 1999, 0, None, None, None]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿paper_id,title,year\r\n,"Quoted ""x"", two\nlines",2020\r\np2,,2022.0\r\n'.encode())
    rows = readers.load_literature(spark, str(tmp_path / "a.csv")).orderBy(ORDER).collect()
    assert rows[0]["title"] == 'Quoted "x", two\nlines' and rows[0]["year"] == 2020 and rows[0]["paper_id"].startswith("paper_")
    assert rows[1]["year"] is None and rows[1]["keywords"] == []
    (tmp_path / "b.json").write_text('{"records": [{"paper_id": "p", "keywords": [" a ", ""], "year": "1999"}]}')
    (tmp_path / "c.json").write_text('[{"paper_id": "p", "title": " t "}]')
    (tmp_path / "d.yaml").write_text("records:\n- paper_id: p\n  keywords: [a, b]\n  year: 2001\n")
    assert readers.load_literature(spark, str(tmp_path / "b.json")).first()["keywords"] == ["a"]
    assert readers.load_literature(spark, str(tmp_path / "c.json")).first()["title"] == "t"
    (tmp_path / "l.json").write_text("".join(json.dumps({"paper_id": f"p{i}", "title": "t"}) + "\n" for i in range(5)))
    (tmp_path / "m.json").write_text(json.dumps({"meta": {"n": 1}, "records": [{"paper_id": "p"}, {"paper_id": "q"}]}, indent=1))
    (tmp_path / "n.json").write_text('{"paper_id": "p"}\n{"paper_id": \n')
    (tmp_path / "o.json").write_text("")
    (tmp_path / "q.json").write_text('{\n "meta": 1,\n "records": []\n}')
    assert [readers.load_literature(spark, str(tmp_path / f"{x}.json")).count() for x in "lmoq"] == [5, 2, 0, 0]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.load_literature(spark, str(tmp_path / "n.json")).collect()
    last = readers.load_literature(spark, str(tmp_path / "d.yaml")).first()
    assert last["keywords"] == ["a", "b"] and last["year"] == 2001
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.txt")
    (tmp_path / "e.yaml").write_text("EEG: [a]\nqc: []\n")
    (tmp_path / "f.yaml").write_text("approved_variables: [b]\n")
    assert readers.load_approved(str(tmp_path / "e.yaml")) == ["a"] and readers.load_approved(str(tmp_path / "f.yaml")) == ["b"]
    with pytest.raises(readers.ConfigError):
        readers.Config({}, tmp_path).path("inputs", "none")


@pytest.mark.parametrize("kind", ["csv", "csv by lines", "json"])
def test_rows_come_back_in_the_order_written(spark, tmp_path, kind):
    """Parts of unequal size, blocks of a file in many tasks, and a part number of six digits."""
    at = str(tmp_path / f"t.{kind[:4].strip()}")
    rows = spark.range(6000).select(F.concat(F.lit("v"), F.repeat(F.lit("x"), (F.col("id") % 7 + F.when(F.col("id") > 4000, 60).otherwise(0)).cast("int"))).alias("wide"), F.col("id").cast("string").alias("n"), F.col("id").alias(ORDER))
    sinks.write_csv(rows.repartition(5), at) if kind != "json" else sinks.write_json(rows.repartition(5), at)
    last = sorted(p.name for p in (tmp_path / f"t.{kind[:4].strip()}").glob("part-*"))[-1]
    folder = tmp_path / f"t.{kind[:4].strip()}"
    (folder / last).rename(folder / last.replace("part-0", "part-10", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        back = readers.read_csv(spark, at, multi_line=kind == "csv") if kind != "json" else readers._json(spark, at)
        got = [(r["n"], r[ORDER]) for r in back.select("n", ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({o for _, o in got}) == 6000
    assert [int(n) for n, _ in sorted(got, key=lambda x: x[1])] == list(range(6000))


def test_a_write_that_fails_leaves_the_old_one(spark, tmp_path):
    at = str(tmp_path / "t.csv")
    assert sinks.write_csv(spark.range(5).toDF("n"), at) == 5
    bad = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("string").alias("n"))
    with pytest.raises(Exception, match="broken"):
        sinks.write_csv(bad, at)
    assert readers.read_csv(spark, at).count() == 5
    sinks.write_yaml({"a": [1, "é"]}, f"file:{tmp_path}/x/y.yaml")
    assert readers.read_yaml(f"file:{tmp_path}/x/y.yaml") == {"a": [1, "é"]}
    with pytest.raises(Exception, match="."):
        files.replaced(spark, f"{tmp_path}/x/y.yaml", lambda new: 1 / 0)
    assert readers.read_yaml(f"{tmp_path}/x/y.yaml") == {"a": [1, "é"]}
    assert sinks.write_csv(spark.range(2).toDF("n"), at) == 2 and readers.read_csv(spark, at).count() == 2
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t.csv", "x"]


def test_staged_tables(spark):
    import os
    from types import SimpleNamespace

    first = staging.staged(spark.range(3).toDF("x"), "first")
    second = staging.staged(first.filter("x > 0"), "second")
    staging.discard(first, spark.range(1))
    assert not os.path.exists(first.staged_at.removeprefix("file://")) and second.count() == 2
    # A folder of one machine is no place for tables on a cluster.
    none = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(getConf=lambda: none, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        staging.shared_dir(cluster)


def test_rules_with_blanks_take_no_grams(spark, monkeypatch):
    """Keywords with blanks are met by a text's words, without its grams; rules beyond SENT come for the keywords met alone."""
    r = random.Random(8)
    some = lambda n: "".join(r.choice("abé") for _ in range(n))
    keywords = [f"{some(3)} {some(3)}" for _ in range(40)] + [f"{some(2)} {some(1)}\t{some(2)}" for _ in range(40)] + ["the ", " bab", "aba  ", "aab \n bab", "not there at all"]
    rules = [(k, f"m{j}", f"v{i}_{j}", "c", i * 100 + j) for i, k in enumerate(keywords) for j in range(3)]
    texts = [" ".join(some(r.randint(1, 4)) for _ in range(80)).replace("  ", " \n ") for _ in range(50)] + ["", "in the a\tb", "aba", None]
    docs = frame(spark, [(f"d{i}", t, "", [], "", "") for i, t in enumerate(texts)], "paper_id string, title string, abstract string, keywords array<string>, notes string, source string")
    table = spark.createDataFrame(rules, f"keyword string, modality string, variable string, mechanism string, {ORDER} long")
    want = sorted((f"d{i}", v) for i, t in enumerate(texts) for k, _, v, _, _ in rules if k in f" {(t or '').lower()}    ")

    def refused(*a):
        raise AssertionError("grams of texts are not needed here")

    monkeypatch.setattr(evidence, "text_grams", refused)
    found = lambda: sorted((q["paper_id"], q["variable_or_feature"]) for q in evidence.extracted(docs, table).collect())
    assert found() == want and len(want) > 200
    for limit in (100, 10):
        monkeypatch.setattr(evidence, "SENT", limit)
        assert found() == want


def test_rising_order_of_files_that_are_not_split(spark, tmp_path):
    """Rows in the order written, by numbers for which nothing is written on the way; odd names of folders and files."""
    at = str(tmp_path / "a b%20c é" / "t")
    rows = spark.range(3000).select(F.concat(F.lit("v\n"), F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))).alias("wide"), F.col("id").cast("string").alias("n"), F.col("id").alias(ORDER))
    sinks.write_csv(rows.repartition(5), at)
    parts = sorted((tmp_path / "a b%20c é" / "t").glob("part-*"))
    parts[-1].rename(parts[-1].with_name(parts[-1].name.replace("part-0", "part-10", 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        back = readers.read_csv(spark, at, order="rising")
        assert "source-rows" not in back._jdf.queryExecution().optimizedPlan().toString() + str(back.inputFiles())
        got = [(r["n"], r[ORDER]) for r in back.select("n", ORDER).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({o for _, o in got}) == 3000 and [int(n) for n, _ in sorted(got, key=lambda x: x[1])] == list(range(3000))
    assert ORDER not in readers.read_csv(spark, at, order="none").columns and readers.read_csv(spark, at, order="none").count() == 3000


def test_merge_groups_each_table_once(spark):
    """An aggregate for each table, not for each cell; rows of subjects that a table repeats are told whole."""
    subjects = frame(spark, [("a", "1", "g")], "subject_id string, x string, y string")
    many = frame(spark, [("a", "2", ""), ("a", "2", "h"), ("b", "", "k"), ("b", "5", "k")], "subject_id string, x string, y string")
    stack, names, within = entities._stacked(subjects, {"EEG": many})
    plan = entities.cells(stack, names, ["x", "y"], within)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") == 1 and plan.count("max_by(") == 1
    merged, log = entities.merged(subjects, {"EEG": many})
    assert {tuple(r) for r in merged.drop(ORDER).collect()} == {("a", "1", "g", "2", "h"), ("b", "", "k", "5", "")}
    assert {(r["column"], r["n"]) for r in log.collect()} == {("x", 3), ("y", 1)}
