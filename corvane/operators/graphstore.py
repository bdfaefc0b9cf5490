"""A stored graph that batches of evidence are added to, without reading or shuffling what is stored.

Nodes lie in a table bucketed by node_id: a batch's nodes are dealt to the same buckets, and an anti join finds the new ones
with no exchange of the stored side. Edges are appended. Each batch is a partition of both tables, and counts once it is
named in `facts`, which is written last; what a batch that failed has left is removed by the next one.

Several batches give the nodes and edges of the graph of all of them together, if no paper has evidence in two batches under
unlike titles (the first title stays). Mappings of a concept count in its first batch; confounds are those the store was made with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import graph
from corvane.sources.files import located, size, write_text
from corvane.sources.readers import ORDER, read_yaml
from corvane.staging import discard, staged

BUCKETS = 32


@dataclass
class GraphStore:
    spark: SparkSession
    path: str
    confounds: tuple[str, ...]
    buckets: int
    batches: int

    @classmethod
    def open(cls, spark: SparkSession, path: str, confounds: Sequence[str] = (), buckets: int = BUCKETS) -> GraphStore:
        """The store at a path, which is made if nothing is there; then with these confounds and buckets."""
        path = path.rstrip("/")
        if size(spark, f"{path}/facts.yaml") < 0:
            out = cls(spark, path, tuple(confounds), buckets, 0)
            out._commit()
            return out
        facts = read_yaml(f"{path}/facts.yaml", spark)
        return cls(spark, path, tuple(facts["confounds"]), facts["buckets"], facts["batches"])

    def _commit(self) -> None:
        import yaml

        write_text(yaml.safe_dump({"confounds": list(self.confounds), "buckets": self.buckets, "batches": self.batches}), f"{self.path}/facts.yaml", self.spark)

    def _table(self) -> str:
        """The nodes as a table of the session's catalog, with the partitions of all batches that count."""
        name = "graph_nodes_" + hashlib.sha1(self.path.encode()).hexdigest()[:16]
        if not self.spark.catalog.tableExists(name):
            place = self.spark.createDataFrame([], NODE_SCHEMA).select(ORDER).schema[0].dataType.simpleString()
            self.spark.sql(
                f"CREATE TABLE {name} (node_id string, label string, node_type string, metadata map<string,string>, {ORDER} {place}, batch int) "
                f"USING parquet PARTITIONED BY (batch) CLUSTERED BY (node_id) INTO {self.buckets} BUCKETS LOCATION '{self.path}/nodes'"
            )
        if size(self.spark, f"{self.path}/nodes") > 0:
            self.spark.catalog.recoverPartitions(name)
        self.spark.catalog.refreshTable(name)
        return name

    def stored(self) -> DataFrame:
        """Nodes of all batches, as the bucketed table has them."""
        return self.spark.table(self._table()).filter(F.col("batch") < self.batches)

    def nodes(self) -> DataFrame:
        """(node_id, label, node_type, metadata), and their order by batch."""
        own = self.stored().select("node_id", "label", "node_type", "metadata", F.struct("batch", ORDER).alias(ORDER))
        confounds = graph.confound_nodes(self.spark, self.confounds) if self.confounds and self.batches else None
        return own if confounds is None else own.unionByName(confounds.withColumn(ORDER, F.struct(F.lit(self.batches).alias("batch"), ORDER)))

    def edges(self) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], f"source string, target string, edge_type string, weight double, {ORDER} int, metadata map<string,string>")
        out = self.spark.read.parquet(*[f"{self.path}/edges/batch={i}" for i in range(self.batches)])
        return out.withColumn("metadata", F.create_map().cast("map<string,string>"))

    def fresh(self, nodes: DataFrame) -> DataFrame:
        """Those of a batch's nodes that the store doesn't have."""
        return nodes.join(self.stored().select("node_id"), "node_id", "left_anti") if self.batches else nodes

    def add(self, papers: DataFrame, evidence: DataFrame, mapping: DataFrame) -> None:
        """Add a batch: its papers, graded evidence and mapping, as for graph.graph(); evidence and mapping as written tables."""
        batch = self.batches
        for part in ("nodes", "edges"):
            fs, at = located(self.spark, f"{self.path}/{part}/batch={batch}")
            fs.delete(at, True)
        # A concept that is stored has its mapping there too.
        concepts = self.fresh(mapping.select(graph._named("mechanism", "concept").alias("node_id"), "concept"))
        own = staged(mapping.join(concepts.select("concept"), "concept", "left_semi").select(*mapping.columns), "graph-mapping")
        nodes, edges = graph.graph(papers, evidence, own)
        new = staged(self.fresh(nodes), "graph-new-nodes")
        dealt = new.withColumn("batch", F.lit(batch)).repartition(self.buckets, "node_id")
        dealt.select("node_id", "label", "node_type", "metadata", ORDER, "batch").write.mode("append").partitionBy("batch").bucketBy(self.buckets, "node_id").format("parquet").saveAsTable(self._table())
        listed = edges.drop("metadata")
        if self.confounds:
            listed = listed.unionByName(graph.confound_edges(new.filter("node_type = 'Variable'"), self.confounds))
        place = F.struct(F.lit(batch).alias("batch"), ORDER).alias(ORDER)
        listed.select("source", "target", "edge_type", "weight", place).write.parquet(f"{self.path}/edges/batch={batch}")
        discard(new, own)
        self.batches += 1
        self._commit()


NODE_SCHEMA = f"{ORDER} struct<part:int,k0:bigint,k1:bigint,k2:bigint,k3:bigint,k4:bigint,k5:bigint>"
