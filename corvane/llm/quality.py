"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every text gets the base measures. Around them, thresholds adapt to each language and source: a histogram sketch
of each measure (integer bins whose width stays within 1/32 of the value, so that sketches of parts merge by adding
counts) gives quartiles, and a document falls outside when a measure lies far beyond the spread between them: up to a
quarter of junk in a group doesn't move its limits. Sketches merge upward, from source to language to all rows, and
each quartile is drawn towards that of the wider group as if `prior` documents of it had been seen: a group of three
documents mostly follows its language, one of a million itself, and no size switches the method off.
Groups are joined by language and source; nothing is read but the table itself, and no group meets in one task:
sketches are counted map-side first.

Null text has no words and no lines. Null language or source form a group of their own, the same as an empty one. Equal
rows are judged alike; of equal values at a quartile the bin's upper end counts. A very long text is measured whole, by
arrays of its words in one row. Other columns are not read and may have any names (`kept` keeps them all). An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import staged

SPACES = r"[\x20\x09-\x0D]+"
#: Measures that a threshold is fitted for, each in thousandths of the words or the lines it is told by.
MEASURES = ("mean_chars", "symbol_rate", "dup_line_rate")
#: Documents of the wider group that a quartile is drawn by; distances between the quartiles, and thousandths, let through beyond them.
PRIOR, SPREAD = 20, 4
SLACK = {"mean_chars": 1500, "symbol_rate": 600, "dup_line_rate": 400}


def paired(column: str, step: int) -> Column:
    """Hashes of each element with the one `step` places on: from hashes of m elements those of m + step, for step <= m."""
    return F.transform(column, lambda x, i: F.xxhash64(x, F.get(column, i + step)))


def repeated_at(hashes: str) -> Column:
    """Windows (hash, place) in order of hash where any hash of the column occurs twice; else none."""
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), order).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def covered(order: str, n: int) -> Column:
    """Words under the windows of repeated_at()'s column that have an equal neighbour. It is a column, not an expression,
    for else each element's comparison would sort anew."""
    near = lambda x, i: F.get(order, i - 1)["h"].eqNullSafe(x["h"]) | F.get(order, i + 1)["h"].eqNullSafe(x["h"])
    at = F.array_sort(F.transform(F.filter(order, near), lambda x: x["i"]))
    return F.aggregate(
        at,
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-n).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(n), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, the group's language and source, and the base measures of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        *keep,
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("__lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("__source"),
        text.alias("__text"),
    )
    split = base.withColumn("__words", F.filter(F.split("__text", SPACES), lambda w: w != "")).withColumn(
        "__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    hashed = split.select(
        *keep,
        "__lang",
        "__source",
        F.size("__words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.size("__lines").cast("bigint").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("__words", lambda w: F.xxhash64(w)).alias("__h"),
    )
    # Hashes of 1, 2, 4 and 8 words; the last 7 places have no full window.
    for step in (1, 2, 4):
        hashed = hashed.withColumn("__h", paired("__h", step))
    hashed = hashed.withColumn("__windows", F.slice("__h", F.lit(1), F.greatest(F.size("__h") - 7, F.lit(0))))
    sorted_ = hashed.withColumn("__order", repeated_at("__windows"))
    measures_ = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered("__order", 8).alias("n_repeat_words")]
    return sorted_.select(*keep, "__lang", "__source", *measures_)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measures() -> dict[str, Column]:
    """In thousandths, whole numbers."""
    return {
        "mean_chars": F.expr("(1000 * word_chars) div greatest(n_words, 1)"),
        "symbol_rate": F.expr("(1000 * n_symbols) div greatest(n_words, 1)"),
        "dup_line_rate": F.expr("(1000 * n_dup_lines) div greatest(n_lines, 1)"),
    }


def to_bin(x: Column) -> Column:
    """Number of the bin of a whole number >= 0: one each up to 63, then 32 to each doubling."""
    e = F.greatest(F.length(F.bin(x)) - 6, F.lit(0)).cast("bigint")
    return F.when(x < 64, x).otherwise(e * 32 + F.floor(x / F.pow(F.lit(2.0), e)).cast("bigint"))


def from_bin(b: Column) -> Column:
    """The largest whole number of a bin."""
    e = F.floor((b - 32) / 32).cast("bigint")
    return F.when(b < 64, b).otherwise((((b - e * 32) + 1) * F.pow(F.lit(2.0), e)).cast("bigint") - 1)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by language, source, measure and bin of the documents that pass the base rules. Two such tables merge by summing."""
    each = F.array(*[F.struct(F.lit(k).alias("measure"), to_bin(v).alias("bin")) for k, v in measures().items()])
    return rows.filter(~base_failed()).select("__lang", "__source", F.explode(each).alias("m")).groupBy("__lang", "__source", "m.measure", "m.bin").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame) -> DataFrame:
    """(level, __lang, __source, measure, total, first and third quartile) by source (0), by language (1) and of all rows (2)."""
    group = ["level", "__lang", "__source", "measure"]
    level = lambda i: F.struct(F.lit(i).alias("level"), (F.col("__lang") if i < 2 else F.lit(None)).alias("l"), (F.col("__source") if i < 1 else F.lit(None)).alias("s"))
    wider = sketch.select(F.explode(F.array(*map(level, range(3)))).alias("g"), "measure", "bin", "n")
    merged = wider.groupBy("g.level", F.col("g.l").alias("__lang"), F.col("g.s").alias("__source"), "measure", "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*group).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    run = merged.select(*group, "bin", F.sum("n").over(up).alias("upto"), F.sum("n").over(Window.partitionBy(*group)).alias("total"))
    q = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), from_bin(F.col("bin"))))
    return run.groupBy(*group).agg(F.first("total").alias("total"), q(1).alias("first"), q(3).alias("third"))


def thresholds(sketch: DataFrame, prior: int, spread: int, slack: dict[str, int]) -> DataFrame:
    """By language and source: for each measure the lowest and highest value let through.

    That is `spread` times the distance between the quartiles beyond the outer ones, and `slack` thousandths more.
    """
    levels = staged(quartiles(sketch), "quality-quartiles")
    at = lambda i, *keys: levels.filter(F.col("level") == i).select(*keys, "measure", *[F.col(c).alias(f"{c}{i}") for c in ("total", "first", "third")])
    joined = at(0, "__lang", "__source").join(at(1, "__lang"), ["__lang", "measure"]).join(F.broadcast(at(2)), "measure")
    for i in (1, 0):
        drawn = {f"{c}{i}": F.expr(f"(total{i} * {c}{i} + {prior} * {c}{i + 1}) div (total{i} + {prior})") for c in ("first", "third")}
        joined = joined.withColumns(drawn)
    wide = spread * (F.col("third0") - F.col("first0")) + F.create_map(*[x for k, v in slack.items() for x in (F.lit(k), F.lit(v).cast("bigint"))])[F.col("measure")]
    cut = joined.select("__lang", "__source", "measure", (F.col("first0") - wide).alias("lo"), (F.col("third0") + wide).alias("hi"))
    limits = [F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"__{c}_{k}") for k in MEASURES for c in ("lo", "hi")]
    return cut.groupBy("__lang", "__source").agg(*limits)


def verdicts(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured() rows with base_failed and kept. Where the cuts' table is small the planner sends it to the rows' tasks.
    Only a group none of whose documents passes the base rules has no cuts."""
    inside = F.lit(True)
    for k, v in measures().items():
        inside = inside & v.between(F.col(f"__lo_{k}"), F.col(f"__hi_{k}"))
    joined = rows.join(cuts, ["__lang", "__source"], "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & inside)


def judged(docs: DataFrame, prior: int = PRIOR, spread: int = SPREAD, slack: dict[str, int] = SLACK) -> DataFrame:
    """doc_id, the base measures, base_failed and kept for every row of docs (doc_id, text, lang, source).

    Measures and thresholds are written as tables: each text is measured once, and the planner knows the thresholds'
    size and sends them to the measures' tasks only if that is below its limit; else it joins by shuffle.
    """
    rows = staged(measured(docs, ["doc_id"]), "quality-measures")
    return verdicts(rows, _cuts(rows, prior, spread, slack)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def kept(docs: DataFrame, prior: int = PRIOR, spread: int = SPREAD, slack: dict[str, int] = SLACK) -> DataFrame:
    """The rows of docs, all columns, that are kept. Rows are written with their measures, so each text is measured once."""
    inner = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    named = inner.select("*", *[F.col(f"__c{docs.columns.index(c)}").alias(c) for c in ("text", "lang", "source")])
    rows = staged(measured(named, inner.columns), "quality-measures")
    return verdicts(rows, _cuts(rows, prior, spread, slack)).filter("kept").select(*inner.columns).toDF(*docs.columns)


def _cuts(rows: DataFrame, prior: int, spread: int, slack: dict[str, int]) -> DataFrame:
    return staged(thresholds(sketches(rows), prior, spread, slack), "quality-thresholds")


def rejected(judged_rows: DataFrame) -> DataFrame:
    """(base_failed, kept, documents): what the base rules and what the thresholds reject."""
    return judged_rows.groupBy("base_failed", "kept").agg(F.count("*").alias("documents"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))
