"""Retrieval: keyword and TF-IDF search over texts, for one query or a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import or_default, runs, strip, text, tokens
from corvane.sources.readers import ORDER, document_text
from corvane.staging import discard, row_count, staged

#: A token in more than this share of all papers is met by broadcast: there are at most 1 / COMMON times a paper's mean number of tokens.
COMMON = 1 / 1000
SINGLE = "__query"


def rewritten(query: Column) -> Column:
    """Hook for query expansion: trims."""
    return strip(query)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, token, qtf) of queries (query_id, query): texts become tokens by the same rule as documents do."""
    each = queries.select("query_id", F.explode(tokens(rewritten(F.col("query")))).alias("token"))
    return each.groupBy("query_id", "token").agg(F.count("*").alias("qtf"))


def corpus(papers: DataFrame) -> DataFrame:
    """paper_id, source, whole text and order of papers."""
    source = or_default(text(F.col("source")), "literature") if "source" in papers.columns else F.lit("literature")
    return papers.select("paper_id", document_text(papers).alias("body"), source.alias("source"), ORDER)


def _check(top_k: int) -> None:
    if top_k < 0:
        raise ValueError("top_k must not be negative")


def _queries(papers: DataFrame, query: str | DataFrame) -> DataFrame:
    """A table of queries as it is given, or one of a single query."""
    if isinstance(query, DataFrame):
        return query.select("query_id", "query")
    return papers.sparkSession.createDataFrame([(0, query)], "query_id long, query string").withColumn(SINGLE, F.lit(True))


def top(scored: DataFrame, top_k: int) -> DataFrame:
    """The best of each query first; equal scores keep the papers' order."""
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), ORDER)
    # Ranks up to a limit are cut before the shuffle, so a query that meets all papers sends top_k of each task.
    best = scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top_k)
    return staged(best.select("query_id", ORDER, "score", "rank"), "retrieval-best")


def shown(found: DataFrame, queries: DataFrame) -> DataFrame:
    """found rows in their order; a single query isn't named."""
    return found.orderBy("rank").drop("query_id", "rank") if SINGLE in queries.columns else found.drop("rank")


def _result(docs: DataFrame, scored: DataFrame, queries: DataFrame, top_k: int) -> DataFrame:
    """What is shown of the best of each query. Texts are fetched for the best alone."""
    found = docs.join(top(scored, top_k), ORDER).select("query_id", "rank", "paper_id", "score", F.substring("body", 1, 300).alias("matched_text"), "source", ORDER)
    return shown(found, queries)


def keyword_retrieve(papers: DataFrame, query: str | DataFrame, top_k: int = 10) -> DataFrame:
    """Papers by how many of their tokens are terms of the query. query: a text, or a table (query_id, query).

    Terms are few beside the papers' tokens, so the planner sends them to the papers; what matches is counted map-side.
    """
    _check(top_k)
    queries, docs = _queries(papers, query), corpus(papers)
    terms = query_terms(queries).select("query_id", "token")
    met = docs.select(ORDER, F.explode(tokens(F.col("body"))).alias("token")).join(terms, "token")
    scored = met.groupBy("query_id", ORDER).agg(F.count("*").cast("double").alias("score"))
    return _result(docs, scored, queries, top_k)


def with_counts(docs: DataFrame) -> DataFrame:
    """docs (body) with `terms`: a text's distinct tokens and how often each stands there, (token, tf), without a shuffle.

    Each step is a column, not an expression, for else it would be worked out anew for every element.
    """
    sorted_ = docs.withColumn("__order", F.sort_array(tokens(F.col("body"))))
    last = F.transform("__order", lambda t, i: F.when(~t.eqNullSafe(F.get("__order", i + 1)), F.struct(t.alias("token"), i.alias("at"))))
    ends = sorted_.withColumn("__ends", F.array_compact(last))
    before = lambda i: F.coalesce(F.get("__ends", i - 1)["at"], F.lit(-1))
    terms = F.transform("__ends", lambda x, i: F.struct(x["token"].alias("token"), (x["at"] - before(i)).cast("bigint").alias("tf")))
    return ends.withColumn("terms", terms).drop("__order", "__ends")


def counted(docs: DataFrame, parts: int) -> DataFrame:
    """(_ord, token, tf) of docs (body), a row for each distinct token of a text.

    Texts are dealt by paper, so that the tokens are counted where they are found, without another shuffle.
    """
    each = docs.repartition(parts, ORDER).select(ORDER, F.explode(runs(F.col("body"))).alias("run"))
    return each.select(ORDER, F.lower("run").alias("token")).groupBy(ORDER, "token").agg(F.count("*").alias("tf"))


def weighed(tf: DataFrame, idf: DataFrame, n: int) -> DataFrame:
    """tf rows with their token's idf. Common tokens come by broadcast, a table of bounded size; the rest by a shuffle without hot keys."""
    common = idf.filter(F.col("df") > COMMON * n).select("token", "idf")
    told = tf.join(F.broadcast(common), "token", "left")
    rare = told.filter("idf IS NULL").drop("idf").join(idf.filter(F.col("df") <= COMMON * n).select("token", "idf"), "token")
    return told.filter("idf IS NOT NULL").select(ORDER, "tf", "idf").unionByName(rare.select(ORDER, "tf", "idf"))


def tfidf_retrieve(papers: DataFrame, query: str | DataFrame, top_k: int = 10) -> DataFrame:
    """Papers by the cosine of TF-IDF vectors, with idf = ln((1 + N) / (1 + df)) + 1. Scores are rounded to 9 digits.

    Papers are split into tokens once, and counted; what is written are each paper's distinct tokens with their frequencies, and
    all else is made from that.
    """
    _check(top_k)
    queries, docs = _queries(papers, query), corpus(papers)
    held = staged(with_counts(docs).select(ORDER, "terms"), "retrieval-tf", counted=True)
    tf, n = held.select(ORDER, F.inline("terms")), max(row_count(held), 1)
    weight = lambda df: F.log(F.lit(1 + n) / (1 + df)) + 1
    idf = staged(tf.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", weight(F.col("df"))), "retrieval-idf")
    asked = query_terms(queries).join(idf, "token", "left").select("query_id", "token", (F.col("qtf") * F.coalesce("idf", weight(F.lit(0)))).alias("qw"), F.col("idf").isNotNull().alias("held"), "idf")
    asked = staged(asked, "retrieval-terms")
    norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
    dots = tf.join(asked.filter("held").select("query_id", "token", (F.col("qw") * F.col("idf")).alias("qw")), "token")
    dots = dots.groupBy("query_id", ORDER).agg(F.sum(F.col("tf") * F.col("qw")).alias("dot"))
    w = F.col("tf") * F.col("idf")
    lengths = weighed(tf, idf, n).groupBy(ORDER).agg(F.sqrt(F.sum(w * w)).alias("dn"))
    score = F.round(F.col("dot") / (F.col("qn") * F.col("dn")), 9).alias("score")
    scored = dots.filter("dot > 0").join(norms, "query_id").join(lengths, ORDER).select("query_id", ORDER, score)
    out = _result(docs, scored, queries, top_k)
    discard(held, idf, asked)
    return out


def retrieve(papers: DataFrame, query: str | DataFrame, top_k: int = 10) -> DataFrame:
    """Keyword search. A TF-IDF search over the same tokens could add nothing where it finds none."""
    return keyword_retrieve(papers, query, top_k)


def selected(papers: DataFrame, hits: DataFrame) -> DataFrame:
    """The papers with an id among the hits, in their own order."""
    return papers.join(hits.select("paper_id").distinct(), "paper_id", "left_semi")
