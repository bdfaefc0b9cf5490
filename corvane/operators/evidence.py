"""Evidence: rule matches in texts, classified and graded."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import first_label, has_any, or_default, stable_id, strip, text
from corvane.operators.skew import COMMON
from corvane.sources.readers import ORDER, document_text
from corvane.staging import row_count, staged


class Rule(NamedTuple):
    keyword: str
    modality: str
    variable: str
    mechanism: str


# Terms of the literature with the modality, variable and mechanism they stand for, in order.
RULES = (
    Rule("slow wave", "EEG", "slow_wave_density", "slow-wave generation"),
    Rule("delta", "EEG", "delta_power", "slow-wave generation"),
    Rule("spindle", "EEG", "spindle_density", "spindle generation"),
    Rule("thalamocortical", "EEG-fMRI", "thalamus_DMN_FC", "thalamocortical coupling"),
    Rule("default mode network", "fMRI", "thalamus_DMN_FC", "thalamocortical coupling"),
    Rule("dmn", "fMRI", "thalamus_DMN_FC", "thalamocortical coupling"),
    Rule("dti", "DTI", "FA", "white matter integrity"),
    Rule(" fa", "DTI", "FA", "white matter integrity"),
    Rule("mri", "MRI", "MRI", "structural morphology"),
    Rule("hippocampus", "MRI", "hippocampus_volume", "hippocampal morphology"),
    Rule("thalamus", "MRI", "thalamus_volume", "thalamic morphology"),
    Rule("isi", "Scale", "ISI", "insomnia severity"),
    Rule("psqi", "Scale", "PSQI", "insomnia severity"),
    Rule("hyperarousal", "EEG", "beta_power", "hyperarousal"),
    Rule("beta", "EEG", "beta_power", "hyperarousal"),
    Rule("salience", "fMRI", "salience_network_FC", "salience network regulation"),
)

# Phrases of each class, in order of precedence, and the weights of the grades.
TYPES = (
    ("meta_analysis", ("meta-analysis", "meta analysis")),
    ("review", ("review",)),
    ("case", ("case",)),
    ("method", ("method",)),
    ("empirical", ("empirical", "study", "findings")),
)
DIRECTIONS = (
    ("null", ("no association", "not associated", "null finding")),
    ("refute", ("refute", "opposite", "lower than expected")),
    ("support", ("associated", "support", "suggest", "show", "reports", "reduced", "increased", "altered", "disrupted")),
)
POPULATIONS = (("insomnia", ("insomnia",)), ("sleep disorder", ("sleep disorder",)), ("adults", ("adults",)))
LIMITATIONS = (("small sample", ("small sample",)), ("cross-sectional", ("cross-sectional",)))
MARKER = "limitation:"
TYPE_WEIGHTS = {"meta_analysis": 0.9, "review": 0.75, "empirical": 0.8, "method": 0.6, "case": 0.35, "unknown": 0.25}
CONFIDENCE = 0.7


def limitation(whole: Column, lowered: Column) -> Column:
    """What follows the first marker, or else a phrase that tells of a limitation."""
    at = F.locate(MARKER, lowered)
    rest = strip(F.substr(whole, at + F.lit(len(MARKER))))
    return F.when(at > 0, rest).otherwise(first_label(lowered, LIMITATIONS, ""))


def extracted(papers: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, default_population: str = "") -> DataFrame:
    """One row for each paper and rule whose keyword stands anywhere in the paper's text, in their order. Ids repeat.

    Classes hang on the paper alone and are worked out before rows multiply. A few rules, given as a sequence, are a literal
    array that is filtered and exploded in place, so nothing is joined or shuffled. Any number of rules may come as a table
    (keyword, modality, variable, mechanism, and `_ord` for their order): see with_rules().
    """
    whole = papers.select("paper_id", "title", document_text(papers).alias("__text"), ORDER).withColumn("__low", F.lower("__text"))
    ids = ("paper_id", "title", F.col(ORDER).alias("__paper"))
    told = {
        "population": first_label(F.col("__low"), POPULATIONS, default_population),
        "direction": first_label(F.col("__low"), DIRECTIONS, "unclear"),
        "evidence_type": first_label(F.col("__low"), TYPES, "unknown"),
        "limitation": limitation(F.col("__text"), F.col("__low")),
    }
    padded = F.concat(F.lit(" "), F.col("__low"), F.lit(" "))
    if isinstance(rules, DataFrame):
        named = with_rules(whole.select(*ids, *[c.alias(name) for name, c in told.items()], padded.alias("__padded")), rules)
    else:
        # Columns in turn, and no filter before rows multiply: it would be pushed below them, and every text searched again.
        hits = F.array(*[F.contains("__padded", F.lit(r.keyword)) for r in rules]).cast("array<boolean>")
        marked = whole.withColumn("__padded", padded).withColumn("__hits", hits)
        known = [F.when(F.array_contains("__hits", True), c).alias(name) for name, c in told.items()]
        rows = marked.select(*ids, *known, F.posexplode_outer("__hits").alias("__rule", "__hit")).filter("__hit").drop("__hit")
        pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("__rule") + 1)
        named = rows.withColumns({"modality": pick([r.modality for r in rules]), "variable_or_feature": pick([r.variable for r in rules]), "mechanism": pick([r.mechanism for r in rules])})
    return named.select(
        stable_id("evidence", F.col("paper_id"), F.col("mechanism"), F.col("variable_or_feature")).alias("evidence_id"),
        "paper_id",
        F.concat(text(F.col("title")), F.lit(": "), F.col("mechanism"), F.lit(" related to "), F.col("variable_or_feature")).alias("claim"),
        "population",
        "modality",
        "variable_or_feature",
        "mechanism",
        "direction",
        "evidence_type",
        "limitation",
        F.lit(CONFIDENCE).alias("confidence_score"),
        F.struct("__paper", "__rule").alias(ORDER),
    )


#: Characters of a gram, and of the pieces that a text's grams are taken from.
GRAM, PIECE = 3, 1 << 14
#: What a keyword with blanks tells of the words of any text that holds it, blanks alike: its last word begins one of the text's,
#: its first one ends one, and a word between two blanks stands there whole. Ends of fewer than GRAM characters tell nothing.
KEYS = (f" [^ ]{{{GRAM}}}", f"[^ ]{{{GRAM}}} ", " [^ ]+(?= )")
#: Keywords, and rules, that go to all tasks; beyond it, they meet by a shuffle. Deals of a keyword that many texts hold.
SENT, DEALS = 200_000, 16


def grams(c: Column, distinct: bool = True) -> Column:
    """All runs of GRAM characters of a short text."""
    out = F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))
    return F.array_distinct(out) if distinct else out


def text_grams(c: Column) -> Column:
    """The distinct grams of a text of any length, piece by piece: a piece's grams may reach into the next one."""
    pieces = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ahead = F.regexp_extract_all(c, F.lit(f"(?s).{{1,{PIECE}}}(?=(.{{0,{GRAM - 1}}}))"), F.lit(1))
    reach = F.zip_with(pieces, ahead, lambda p, a: F.concat(p, a))
    return F.aggregate(reach, F.array().cast("array<string>"), lambda held, p: F.array_union(held, grams(p, False)))


def text_keys(c: Column, kinds: Sequence[int] = range(len(KEYS))) -> Column:
    """The distinct keys of these kinds of a text's words: no element is worked on by itself, so Spark compiles it."""
    plain = F.translate(c, "\t\n\v\f\r", " " * 5)
    return F.array_distinct(F.concat(*[F.regexp_extract_all(plain, F.lit(KEYS[k]), F.lit(0)) for k in kinds]))


def rule_index(keywords: DataFrame) -> DataFrame:
    """(keyword, kind, at) of distinct keywords: each under that of its keys that fewest keywords have, the longest of ties, or,
    if it has no key, under such a gram (kind len(KEYS)).

    A keyword shorter than a gram has neither (null): texts are held against it one by one.
    """
    own = F.col("keyword")
    of = lambda k, cells: F.transform(cells, lambda x: F.struct(F.lit(k).alias("kind"), x.alias("at")))
    told, plain = F.concat(*[of(k, text_keys(own, [k])) for k in range(len(KEYS))]), of(len(KEYS), grams(own))
    each = keywords.select("keyword", F.explode_outer(F.when(F.size(told) > 0, told).otherwise(plain)).alias("x")).select("keyword", "x.*")
    shared = each.filter("at IS NOT NULL").groupBy("kind", "at").agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("kind", "at"), F.struct("n", -F.length("at"), "at")).alias("x")
    return each.join(shared, ["kind", "at"], "left").groupBy("keyword").agg(best).select("keyword", "x.*")


def with_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts (with __padded) with a row for each rule whose keyword stands in __padded, in place of that column.

    A text's distinct keys meet the index, each keyword under its rarest key, and a keyword that is met is then looked for in
    the text; for keywords without blanks, grams do the same. Up to SENT keywords, counted, the index is sent to the tasks, and
    no text is shuffled. Rules come last, by broadcast up to SENT; if there are more, those of the keywords that were met.
    Rules without a keyword match nothing.
    """
    about = (F.col(ORDER).alias("__rule"), text(F.col("modality")).alias("modality"), text(F.col("variable")).alias("variable_or_feature"), text(F.col("mechanism")).alias("mechanism"))
    listed = staged(rules.filter("keyword IS NOT NULL").select("keyword", *about), "rules", counted=True)
    index = staged(rule_index(listed.select("keyword").distinct()), "rule-index", counted=True)
    sent = (lambda df: F.broadcast(df)) if row_count(index) <= SENT else (lambda df: df)
    own = [c for c in texts.columns if c != "__padded"]

    def meeting(cells: Column, among: Column) -> DataFrame:
        # A column, and outer, for else Spark works the cells out twice and copies the text for each of them.
        each = texts.withColumn("__cells", cells).select(*texts.columns, F.explode_outer("__cells").alias("at"))
        return each.join(sent(index.filter(among).select("at", "keyword")), "at").filter(F.contains("__padded", F.col("keyword"))).select(*own, "keyword")

    # The kinds of keys that there are, of grams, and of short keywords: a handful.
    kinds = {r["kind"] for r in index.select("kind").distinct().collect()}
    padded, kind, met = F.col("__padded"), F.col("kind"), []
    if whole := sorted(kinds & set(range(len(KEYS)))):
        met.append(meeting(text_keys(padded, whole), kind < len(KEYS)))
    if len(KEYS) in kinds:
        met.append(meeting(text_grams(padded), kind == len(KEYS)))
    if None in kinds:
        # Keywords of fewer characters than a gram: there are few such strings, and each is looked for by itself.
        every = [r["keyword"] for r in index.filter(kind.isNull()).collect()]
        short = F.array_compact(F.array(*[F.when(F.contains(padded, F.lit(k)), F.lit(k)) for k in every]))
        met.append(texts.select(*own, F.explode(short).alias("keyword")))
    out = reduce(DataFrame.unionByName, met) if met else texts.select(*own, F.lit("").alias("keyword")).limit(0)
    return _ruled(out, listed).select(*own, "__rule", "modality", "variable_or_feature", "mechanism")


def _ruled(met: DataFrame, rules: DataFrame) -> DataFrame:
    """met (keyword, any more) with the rules of each keyword."""
    if row_count(rules) <= SENT:
        return met.join(F.broadcast(rules), "keyword")
    met = staged(met, "rules-met", counted=True)
    asked = staged(met.groupBy("keyword").agg(F.count("*").alias("n")), "rules-asked", counted=True)
    few = F.broadcast(asked) if row_count(asked) <= SENT else asked
    rules = staged(rules.join(few, "keyword", "left_semi"), "rules-asked-for", counted=True)
    if row_count(rules) <= SENT:
        return met.join(F.broadcast(rules), "keyword")
    # Rows of a keyword that many texts hold are dealt out, and its rules go to each deal. There are at most 1 / COMMON such keywords.
    hot = F.broadcast(asked.filter(F.col("n") > COMMON * row_count(met)).select("keyword", F.lit(DEALS).alias("__deals")))
    dealt = F.when(F.col("__deals").isNotNull(), F.pmod(F.xxhash64(*[c for c in met.columns if c != "keyword"]), F.lit(DEALS))).otherwise(0).cast("int")
    rows = met.join(hot, "keyword", "left").withColumn("__deal", dealt).drop("__deals")
    each = F.explode(F.sequence(F.lit(0), F.coalesce("__deals", F.lit(1)) - 1))
    return rows.join(rules.join(hot, "keyword", "left").withColumn("__deal", each).drop("__deals"), ["keyword", "__deal"])


def graded(evidence: DataFrame, weights: Mapping[str, float] = TYPE_WEIGHTS) -> DataFrame:
    """evidence with evidence_quality_score: the type's weight, more for what a record tells and less for what it lacks."""
    base = F.coalesce(*[F.when(F.col("evidence_type") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.25))
    told = lambda c, w: F.when(text(F.col(c)) != "", F.lit(w)).otherwise(F.lit(-w))
    score = base + told("population", 0.03) + told("modality", 0.04) + told("variable_or_feature", 0.04)
    score = score + F.when(F.col("direction") != "unclear", F.lit(0.04)).otherwise(F.lit(-0.04))
    score = score + F.when(text(F.col("limitation")) != "", F.lit(0.03)).otherwise(F.lit(0.0))
    return evidence.withColumn("evidence_quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 3))


def direction_counts(evidence: DataFrame) -> DataFrame:
    """How many rows there are of each direction; all four are listed."""
    return _counts(evidence, "direction", ("support", "refute", "null", "unclear"))


def _counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    every = df.sparkSession.createDataFrame(list(enumerate(values)), f"{ORDER} long, {column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), ORDER)


def quality_summary(evidence: DataFrame) -> DataFrame:
    score = F.coalesce("evidence_quality_score", F.lit(0.0))
    return evidence.agg(F.count("*").alias("n"), F.min(score).alias("lowest"), F.avg(score).alias("mean"), F.max(score).alias("highest"))

