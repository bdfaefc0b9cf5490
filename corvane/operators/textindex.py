"""A stored inverted index: postings by token, document frequencies and norms, which searches read instead of the texts.

An index is a folder of tables that any session opens by its path:

* `postings` (bucket, token, _ord, tf), a folder for each bucket of tokens, a token's rows side by side within files: a search
  reads the buckets of its own tokens alone;
* `tokens` (bucket, token, df, idf);
* `norms` (_ord, norm), the length of each paper's vector;
* `papers` (_ord, paper_id, source, matched_text): what a result shows;
* `facts`: the number of papers, and of buckets.

The papers are read once. Terms are weighed and scored as by retrieval's searches, so the rows are the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import retrieval
from corvane.sources.files import replaced, size
from corvane.sources.readers import ORDER
from corvane.staging import discard, row_count, staged

#: Folders that tokens are dealt to; a search reads those of its tokens.
BUCKETS = 32
#: Papers whose tokens are counted in one task, and papers whose postings of a bucket are one file.
COUNTED, PIECE = 4000, 50_000


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(1 + n) / (1 + df)) + 1


@dataclass
class TextIndex:
    path: str
    postings: DataFrame
    tokens: DataFrame
    norms: DataFrame
    papers: DataFrame
    total: int
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TextIndex:
        facts = spark.read.parquet(f"{path}/facts").first()
        papers = spark.read.parquet(f"{path}/papers")
        # Schemas are given, as an index of no papers has no files to tell them.
        order = f"{ORDER} {papers.schema[ORDER].dataType.simpleString()}"
        kinds = {"postings": f"token string, {order}, tf long, bucket int", "tokens": "token string, df long, idf double, bucket int", "norms": f"{order}, norm double"}
        return cls(path, *[spark.read.schema(k).parquet(f"{path}/{t}") for t, k in kinds.items()], papers, facts["papers"], facts["buckets"])

    @classmethod
    def there(cls, spark: SparkSession, path: str) -> bool:
        return size(spark, f"{path}/facts") >= 0

    @classmethod
    def build(cls, papers: DataFrame, path: str, buckets: int = BUCKETS) -> TextIndex:
        """Index papers at a path, in place of the index that is there, which stays readable until the new one is whole."""
        spark = papers.sparkSession
        replaced(spark, path, lambda new: _write(papers, new, buckets))
        return cls.open(spark, path)

    def _terms(self, query: str | DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
        """(queries, their terms with buckets, the buckets that are read: at most all of them)."""
        queries = retrieval._queries(self.papers, query)
        terms = staged(retrieval.query_terms(queries).withColumn("bucket", bucket_of(F.col("token"), self.buckets)), "index-terms")
        return queries, terms, sorted(r["bucket"] for r in terms.select("bucket").distinct().collect())

    def _found(self, scored: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
        best = retrieval.top(scored, top_k)
        shown = self.papers.join(best, ORDER).select("query_id", "rank", "paper_id", "score", "matched_text", "source", ORDER)
        return retrieval.shown(shown, queries)

    def keyword(self, query: str | DataFrame, top_k: int = 10) -> DataFrame:
        """As retrieval.keyword_retrieve of the indexed papers."""
        retrieval._check(top_k)
        queries, terms, read = self._terms(query)
        met = self.postings.filter(F.col("bucket").isin(read)).join(terms.select("query_id", "token", "bucket"), ["bucket", "token"])
        scored = met.groupBy("query_id", ORDER).agg(F.sum("tf").cast("double").alias("score"))
        return self._found(scored, queries, top_k)

    def tfidf(self, query: str | DataFrame, top_k: int = 10) -> DataFrame:
        """As retrieval.tfidf_retrieve of the indexed papers."""
        retrieval._check(top_k)
        queries, terms, read = self._terms(query)
        known = self.tokens.filter(F.col("bucket").isin(read)).select("bucket", "token", "idf")
        asked = terms.join(known, ["bucket", "token"], "left")
        weight = F.col("qtf") * F.coalesce("idf", idf(F.lit(0), max(self.total, 1)))
        asked = staged(asked.select("query_id", "token", "bucket", weight.alias("qw"), "idf"), "index-asked")
        norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
        held = asked.filter("idf IS NOT NULL").select("query_id", "token", "bucket", (F.col("qw") * F.col("idf")).alias("qw"))
        met = self.postings.filter(F.col("bucket").isin(read)).join(held, ["bucket", "token"])
        dots = met.groupBy("query_id", ORDER).agg(F.sum(F.col("tf") * F.col("qw")).alias("dot"))
        score = F.round(F.col("dot") / (F.col("qn") * F.col("norm")), 9).alias("score")
        scored = dots.filter("dot > 0").join(norms, "query_id").join(self.norms, ORDER)
        return self._found(scored.select("query_id", ORDER, score), queries, top_k)


@contextmanager
def _open_files(spark: SparkSession, files: int) -> Iterator[None]:
    """Tasks may write to so many folders at once, so that rows keep an order that doesn't begin with the folder."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, "0")
    spark.conf.set(key, str(files))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _write(papers: DataFrame, path: str, buckets: int) -> None:
    spark = papers.sparkSession
    # The papers are read once; all tables come from what is written here.
    held = staged(retrieval.corpus(papers), "index-papers", counted=True)
    n = max(row_count(held), 1)
    held.select(ORDER, "paper_id", "source", F.substring("body", 1, 300).alias("matched_text")).write.parquet(f"{path}/papers")
    tf = retrieval.counted(held.select(ORDER, "body"), max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // COUNTED))
    # Postings are shuffled once. Every bucket is dealt over files by paper, so no token's rows all meet in one task. One number
    # sorts them by bucket and then by token, which Spark does without comparing rows.
    dealt = tf.withColumn("bucket", bucket_of(F.col("token"), buckets)).withColumn("__piece", F.pmod(F.xxhash64(ORDER), F.lit(n // PIECE + 1)))
    place = F.shiftleft(F.col("bucket").cast("bigint"), 48).bitwiseOR(F.shiftrightunsigned(F.xxhash64("token"), 16))
    dealt = dealt.repartition("bucket", "__piece").withColumn("__place", place).sortWithinPartitions("__place")
    with _open_files(spark, buckets):
        dealt.select("bucket", "token", ORDER, "tf").write.partitionBy("bucket").parquet(f"{path}/postings")
    discard(held)
    order = f"{ORDER} {held.schema[ORDER].dataType.simpleString()}"
    postings = spark.read.schema(f"token string, {order}, tf long, bucket int").parquet(f"{path}/postings")
    table = postings.groupBy("bucket", "token").agg(F.count("*").alias("df")).withColumn("idf", idf(F.col("df"), n))
    table.repartition("bucket").sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(f"{path}/tokens")
    known = spark.read.schema("token string, df long, idf double, bucket int").parquet(f"{path}/tokens")
    w = F.col("tf") * F.col("idf")
    lengths = retrieval.weighed(postings.select(ORDER, "token", "tf"), known.select("token", "df", "idf"), n).groupBy(ORDER)
    lengths.agg(F.sqrt(F.sum(w * w)).alias("norm")).write.parquet(f"{path}/norms")
    facts = spark.range(1, numPartitions=1).select(F.lit(row_count(held)).cast("bigint").alias("papers"), F.lit(buckets).alias("buckets"))
    facts.write.parquet(f"{path}/facts")
