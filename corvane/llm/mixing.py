"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks, in DataFrame functions alone.

The words of a source's documents, in a seeded order, are one long row that is cut into blocks of `BLOCK` words (less in
a small source, so that it has some 256 of them; the last block holds the rest). A source's target, in blocks, is its
weight in the apportionment: block after block goes to the source with the highest quotient target / (2 * given + 1),
which needs no list of all awards: for each shard's end the divisor is known up to a bracket, and at most two quotients
a source lie within it. The difference of two ends is the shard's integer quota of each source. Which block an award
takes is told by a seeded stride through the source's blocks that meets each one once before any comes again, so a block
is taken once more or less than another at most, and never more often than `most` times.

Targets: sources in code point order (null last) take the weights in turn and share `share` times all words; what a
source would get beyond `most` times its own words goes to the others by weight, until none is above.

No group meets in one task: places along a source come from sums by bucket of a hash of the row (about 4,096 rows each),
and a bucket's own running sum. One row a source, and one a source and bucket, is all that an unsplit window sees.

Null text has no words and null sources are a source of their own, the last. Documents without words take none. Equal rows are
counted first and follow one another, so they may take unlike numbers of words, and the same on every run; rows under one
doc_id with unlike texts are documents of their own. A very long text is one row like any other. Other columns are not
read and may have any names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, least blocks of a source that has as many words, blocks of a shard of the mix, and rows that one running sum sees.
BLOCK, LEAST_BLOCKS, SHARD_BLOCKS, BUCKET_ROWS = 64, 256, 1 << 16, 4096
# Primes, of which one that doesn't divide a source's number of blocks is its stride.
STRIDES = (15485863, 15485867, 15485917, 15485927, 15485933, 15485941, 15485959, 15485989, 15485993)


def _div(a: Column | str, b: Column | str) -> Column:
    return F.call_function("div", F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def units(docs: DataFrame, seed: int) -> DataFrame:
    """(doc_id, source, key, size, place, n): each distinct document with how often it stands there and its seeded place."""
    source = F.col("source").cast("string")
    rows = docs.select(
        "doc_id",
        source.alias("source"),
        # A key that isn't null, for joins.
        F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("key"),
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("size"),
        F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.coalesce("text", F.lit(""))).alias("place"),
    )
    return rows.groupBy("doc_id", "source", "key", "size", "place").agg(F.count("*").alias("n"))


def with_bucket(rows: DataFrame, total: int) -> DataFrame:
    """rows with the leading bits of their place: as many buckets as leave about BUCKET_ROWS rows in each."""
    bits = max(0, (max(total, 1) - 1) // BUCKET_ROWS).bit_length()
    return rows.withColumn("bucket", F.shiftrightunsigned("place", 64 - bits) if bits else _long(0))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(key, source, source_size, rank, target) of sources (key, source, source_size).

    In order of cap by weight, a source is capped if its cap is less than what its weight gets of all that those before
    leave; the first that isn't sets the level of all others. That is where repeated resharing ends.
    """
    every, named = Window.partitionBy(), Window.orderBy(F.asc_nulls_last("source"))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1)
    cap = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("rank", F.row_number().over(named)).withColumns({"weight": turn, "cap": cap})
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(every) - before) / left)
    rows = rows.withColumn("capped", F.col("ratio") <= F.col("level"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(every)
    return rows.select("key", "source", "source_size", "rank", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def blocked(rows: DataFrame, seed: int, most: int = MOST) -> DataFrame:
    """targets() with the block length, number of blocks, target in blocks, most awards, stride and start of each source."""
    rows = rows.withColumn("length", F.greatest(F.lit(1), F.least(F.lit(BLOCK), _div("source_size", _long(LEAST_BLOCKS)))).cast("bigint"))
    rows = rows.withColumn("blocks", _div(F.col("source_size") + F.col("length") - 1, "length"))
    lot = F.pmod(F.xxhash64(F.lit(seed), "key"), _long(len(STRIDES)))
    fit = F.filter(F.array(*map(_long, STRIDES)), lambda p: (F.col("blocks") % p) != 0)
    stride = F.coalesce(F.get(fit, (lot % F.greatest(F.size(fit), F.lit(1))).cast("int")), _long(1))
    return rows.withColumns(
        {
            "wanted": F.col("target") / F.col("length"),
            "limit": F.col("blocks") * most,
            "stride": stride,
            "start": F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.greatest("blocks", _long(1))),
        }
    )


def apportioned(sources: DataFrame, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """(key, shard, seats, quota): blocks that each source has by the end of each shard, and those of the shard alone.

    sources: (key, rank, wanted, limit). With S sources and H blocks in all, divisors of W / (H + S / 2 + 1) and
    W / (H - S / 2 - 1) give at least and at most H, so only quotients between them are ranked: two a source on average.
    Ties go to the source that comes first.
    """
    every, at = Window.partitionBy(), Window.partitionBy("shard")
    rows = sources.select("key", "rank", "wanted", "limit", F.sum("wanted").over(every).alias("w"), F.count("*").over(every).alias("s"))
    rows = rows.withColumn("house", F.round("w").cast("bigint"))
    last = _div(F.col("house") + _long(shard_blocks - 1), _long(shard_blocks))
    rows = rows.filter("house > 0").withColumn("shard", F.explode(F.sequence(_long(0), F.greatest(last, _long(1)) - 1)))
    rows = rows.withColumn("upto", F.least((F.col("shard") + 1) * shard_blocks, F.col("house")))
    slack = F.col("s") / 2 + 1
    seats = lambda parts: F.least(F.col("limit"), F.floor(F.col("wanted") * F.greatest(parts, F.lit(0.0)) / F.col("w") + 0.5)).cast("bigint")
    low = F.when(F.col("upto") > slack, seats(F.col("upto") - slack)).otherwise(_long(0))
    rows = rows.withColumns({"low": low, "high": seats(F.col("upto") + slack)})
    rows = rows.withColumn("open", F.col("upto") - F.sum("low").over(at))
    some = F.when(F.col("high") > F.col("low"), F.sequence(F.col("low"), F.col("high") - 1))
    tried = rows.select("*", F.explode_outer(some).alias("given"))
    quotient = F.col("wanted") / (2 * F.col("given") + 1)
    place = F.row_number().over(at.orderBy(F.desc_nulls_last(quotient), "rank"))
    won = tried.withColumn("won", F.col("given").isNotNull() & (place <= F.col("open")))
    out = won.groupBy("key", "shard").agg((F.first("low") + F.count_if("won")).alias("seats"))
    return out.withColumn("quota", F.col("seats") - F.coalesce(F.lag("seats").over(Window.partitionBy("key").orderBy("shard")), _long(0)))


def turn_of(block: Column) -> Column:
    """The place of a block in its source's seeded order."""
    return (F.col("stride") * block + F.col("start")) % F.greatest("blocks", _long(1))


def copies(block: Column) -> Column:
    """How often the mix takes a block of a source that has `seats` awards."""
    blocks = F.greatest("blocks", _long(1))
    return _div(F.col("seats"), blocks) + F.when(turn_of(block) < F.col("seats") % blocks, 1).otherwise(0)


def placed(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, shard_blocks: int = SHARD_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(rows, quotas). rows: each row of docs (doc_id, source, text) with where its words begin in its source's row of
    words (`begin`), and its source's target, blocks and seats; quotas: apportioned()."""
    distinct = staged(units(docs, seed), "mixing-units")
    rows = with_bucket(distinct, distinct.count())
    sums = staged(rows.groupBy("key", "source", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("words")), "mixing-sums")
    sources = sums.groupBy("key", "source").agg(F.sum("words").alias("source_size"))
    sources = staged(blocked(targets(sources, weights, share, most), seed, most), "mixing-sources")
    quotas = staged(apportioned(sources, shard_blocks), "mixing-quotas")
    seats = quotas.groupBy("key").agg(F.max("seats").alias("seats"))
    about = sources.drop("source", "rank", "wanted", "limit").join(seats, "key", "left").fillna(0, ["seats"])
    first = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), _long(0))
    offsets = sums.select("key", "bucket", first.alias("offset"))
    within = Window.partitionBy("key", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("upto", F.sum(F.col("n") * F.col("size")).over(within)).join(offsets, ["key", "bucket"]).join(about, "key")
    begin = F.col("offset") + F.col("upto") - F.col("n") * F.col("size")
    # Equal rows, counted until here, stand one after the other.
    each = own.withColumn("begin", begin).withColumn("again", F.explode(F.sequence(_long(0), F.col("n") - 1)))
    return each.withColumn("begin", F.col("begin") + F.col("again") * F.col("size")).drop("upto", "offset", "again", "n"), quotas


def _spans() -> Column:
    """The blocks that a row's words lie in."""
    ends = F.col("begin") + F.col("size") - 1
    return F.when(F.col("size") > 0, F.sequence(_div("begin", "length"), _div(ends, "length"))).otherwise(F.array().cast("array<bigint>"))


def _overlap(block: Column) -> Column:
    return F.least((block + 1) * F.col("length"), F.col("begin") + F.col("size")) - F.greatest(block * F.col("length"), F.col("begin"))


def mixed(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs: the words that the mix takes of it, repeats counted."""
    rows, _ = placed(docs, seed, weights, share, most)
    taken = F.aggregate(_spans(), _long(0), lambda s, k: s + _overlap(k) * copies(k))
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def pieces(docs: DataFrame, seed: int = 0, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix itself: (shard, source, award, doc_id, first_word, words), a row for each stretch of a document in each block taken.

    Awards are told by source and number; a shard's are those between the seats at its ends, found by a join on the
    number's bucket, which each quota is listed under.
    """
    rows, quotas = placed(docs, seed, weights, share, most, shard_blocks)
    cut = rows.withColumn("block", F.explode(_spans())).withColumn("again", F.explode(F.when(copies(F.col("block")) > 0, F.sequence(_long(0), copies(F.col("block")) - 1))))
    award = F.col("again") * F.col("blocks") + turn_of(F.col("block"))
    wide = F.lit(max(1, shard_blocks // 16))
    cut = cut.withColumn("award", award).withColumn("about", _div("award", wide.cast("bigint")))
    ends = quotas.filter("quota > 0").select("key", "shard", (F.col("seats") - F.col("quota")).alias("from_award"), F.col("seats").alias("to_award"))
    ends = ends.withColumn("about", F.explode(F.sequence(_div("from_award", wide.cast("bigint")), _div(F.col("to_award") - 1, wide.cast("bigint")))))
    met = cut.join(ends, ["key", "about"]).filter("award >= from_award AND award < to_award")
    first = F.greatest(F.col("block") * F.col("length"), F.col("begin")) - F.col("begin")
    return met.select("shard", "source", "award", "doc_id", first.alias("first_word"), _overlap(F.col("block")).alias("words"))


def op11_mixing(spark, sf_dir: str) -> DataFrame:
    """Words of each document in the mix of all sources."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
