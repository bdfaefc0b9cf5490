"""Concept mapping, and the graph of papers, findings, mechanisms, variables and confounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.readers import ORDER

# Confidence by whether one or several candidates are there, and the weight of a confound.
MAPPED, AMBIGUOUS, CONFOUND_WEIGHT = 0.9, 0.65, 0.2


def concepts(evidence: DataFrame) -> DataFrame:
    """(concept): each mechanism once, in order of first appearance."""
    return evidence.filter("mechanism <> ''").groupBy(F.col("mechanism").alias("concept")).agg(F.min(ORDER).alias(ORDER))


def mapped(evidence: DataFrame, ready: DataFrame, rules: Sequence[tuple[str, str, Sequence[str]]]) -> DataFrame:
    """Each concept with the candidates that are ready features, in the rules' order, and what that says of the mapping."""
    spark = evidence.sparkSession
    table = spark.createDataFrame([(k, m, list(c)) for k, m, c in rules], "concept string, modality string, candidate_variables array<string>")
    known = concepts(evidence).join(F.broadcast(table), "concept", "left")
    names = ready.select(F.col("feature_name").alias("candidate"), F.lit(True).alias("there")).distinct()
    each = known.select("concept", F.posexplode("candidate_variables").alias("at", "candidate")).join(names, "candidate")
    found = each.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("at", "candidate"))).alias("own"))
    empty = F.array().cast("array<string>")
    rows = known.join(found, "concept", "left").withColumn("own", F.coalesce(F.transform("own", lambda x: x["candidate"]), empty))
    n = F.size("own")
    return rows.select(
        "concept",
        F.coalesce("candidate_variables", empty).alias("candidate_variables"),
        F.col("own").alias("approved_data_features"),
        F.coalesce("modality", F.lit("")).alias("modality"),
        F.when(n == 1, MAPPED).when(n > 1, AMBIGUOUS).otherwise(0.0).alias("mapping_confidence"),
        F.when(n == 1, "mapped").when(n > 1, "ambiguous").otherwise("unavailable").alias("mapping_status"),
        ORDER,
    )


def grounded_variables(mapping: DataFrame) -> DataFrame:
    """(variable): all approved features of all concepts, distinct and sorted."""
    return mapping.select(F.explode("approved_data_features").alias("variable")).distinct().orderBy("variable")


def _node(node_id: Column, label: Column, kind: str, at: int, **metadata: Column) -> Column:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    about = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(node_id.alias("node_id"), label.alias("label"), F.lit(kind).alias("node_type"), about.alias("metadata"), F.lit(at).alias("at"))


def _edge(source: Column, target: Column, kind: Column | str, weight: Column, at: int) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.struct(source.alias("source"), target.alias("target"), kind.alias("edge_type"), weight.cast("double").alias("weight"), F.lit(at).alias("at"))


def _named(prefix: str, c: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(c))


def _order(part: int, *columns: str) -> Column:
    """A comparable place across the parts of a union: the part, then the text of its own order padded by numbers."""
    return F.struct(F.lit(part).alias("part"), *[F.col(c).cast("bigint").alias(f"k{i}") for i, c in enumerate(columns)], *[F.lit(0).cast("bigint").alias(f"k{i}") for i in range(len(columns), 6)])


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumns({"__p": F.col(f"{ORDER}.__paper"), "__r": F.col(f"{ORDER}.__rule")})


def _part(df: DataFrame, cells: Column, k: int, *at: str) -> DataFrame:
    """The exploded nodes or edges of df's rows, with their place in part k."""
    return df.select(*at, F.inline(cells)).withColumn(ORDER, _order(k, *at, "at")).drop(*at, "at")


def _features(mapping: DataFrame) -> DataFrame:
    return _placed(mapping).select("__p", "__r", "mapping_confidence", F.posexplode("approved_data_features").alias("__f", "feature"))


def _variables(evidence: DataFrame, mapping: DataFrame) -> DataFrame:
    """(node_id, _ord) of each variable's node, from the variables alone."""
    own = F.array(_node(_named("variable", "variable_or_feature"), F.col("variable_or_feature"), "Variable", 3))
    more = F.array(_node(_named("variable", "feature"), F.col("feature"), "Variable", 1))
    each = _part(_placed(evidence), own, 0, "__p", "__r").unionByName(_part(_features(mapping), more, 1, "__p", "__r", "__f"))
    return each.groupBy("node_id").agg(F.min(ORDER).alias(ORDER))


def confound_edges(variables: DataFrame, confounds: Sequence[str]) -> DataFrame:
    """An edge from each confound to each variable's node. The confounds are a literal list, exploded in place."""
    listed = F.array(*[F.lit(c) for c in confounds]) if confounds else F.array().cast("array<string>")
    pairs = variables.select("node_id", F.col(ORDER).alias("__v"), F.posexplode(listed).alias("__c", "confound"))
    at = F.struct(F.lit(2).alias("part"), F.col("__c").cast("bigint").alias("k0"), F.col("__v.part").cast("bigint").alias("k1"), *[F.col(f"__v.k{i}").alias(f"k{i + 2}") for i in range(4)])
    return pairs.select(_named("confound", "confound").alias("source"), F.col("node_id").alias("target"), F.lit("confound_affects_variable").alias("edge_type"), F.lit(CONFOUND_WEIGHT).alias("weight"), at.alias(ORDER))


def confound_nodes(spark: SparkSession, confounds: Sequence[str]) -> DataFrame:
    listed = spark.createDataFrame(list(enumerate(confounds)), "__c long, confound string")
    told = F.array(_node(_named("confound", "confound"), F.col("confound"), "Confound", 0))
    return listed.select("__c", F.inline(told)).withColumn(ORDER, _order(2, "__c")).drop("__c", "at")


def graph(papers: DataFrame, evidence: DataFrame, mapping: DataFrame, confounds: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges), neither of which is computed here. Nodes are distinct by id, the first label and metadata staying; edges
    are a bag.

    Evidence and mapping, which both are made from, should be written tables. Each source's nodes and edges come from one
    exploded array, and only nodes need the papers' titles.
    """
    titles = papers.groupBy("paper_id").agg(F.max_by("title", ORDER).alias("__title"))
    own, features = _placed(evidence), _features(mapping)
    paper, finding, mechanism = _named("paper", "paper_id"), _named("finding", "evidence_id"), _named("mechanism", "mechanism")
    variable, modality = _named("variable", "variable_or_feature"), _named("modality", "modality")
    found = F.array(
        _node(paper, F.coalesce("__title", "paper_id"), "Paper", 0, paper_id=F.col("paper_id")),
        _node(finding, F.col("claim"), "Finding", 1, evidence_id=F.col("evidence_id")),
        _node(mechanism, F.col("mechanism"), "Mechanism", 2),
        _node(variable, F.col("variable_or_feature"), "Variable", 3),
        _node(modality, F.col("modality"), "Modality", 4),
    )
    score = F.col("evidence_quality_score")
    weight = F.when(score.isNull() | (score == 0), 1.0).otherwise(score)
    says = F.when(F.col("direction") == "refute", "finding_refutes_mechanism").otherwise("finding_supports_mechanism")
    plain = F.lit(1.0)
    links = F.array(
        _edge(paper, finding, "paper_reports_finding", plain, 0),
        _edge(finding, mechanism, says, weight, 1),
        _edge(mechanism, variable, "mechanism_measured_by_variable", plain, 2),
        _edge(variable, modality, "variable_belongs_to_modality", plain, 3),
    )
    feature, measured = _named("data_feature", "feature"), _named("variable", "feature")
    more = F.array(_node(feature, F.col("feature"), "DataFeature", 0), _node(measured, F.col("feature"), "Variable", 1))
    titled = own.join(titles, "paper_id", "left")
    nodes = _part(titled, found, 0, "__p", "__r").unionByName(_part(features, more, 1, "__p", "__r", "__f"))
    nodes = nodes.groupBy("node_id").agg(F.min_by(F.struct("label", "node_type", "metadata"), ORDER).alias("own"), F.min(ORDER).alias(ORDER)).select("node_id", "own.*", ORDER)
    mapping_edge = F.array(_edge(measured, feature, "variable_mapped_to_data_feature", F.col("mapping_confidence"), 0))
    edges = _part(own, links, 0, "__p", "__r").unionByName(_part(features, mapping_edge, 1, "__p", "__r", "__f"))
    if confounds:
        edges = edges.unionByName(confound_edges(_variables(evidence, mapping), confounds))
        nodes = nodes.unionByName(confound_nodes(papers.sparkSession, confounds))
    about = F.create_map().cast("map<string,string>")
    return nodes, edges.withColumn("metadata", about)
