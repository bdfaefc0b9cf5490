"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group. Groups are hashed into a fixed number of parcels, but a heavy group is a parcel of its own.
Only the parcels' sizes, a table with a proven bound of rows, reach the packer: it takes them from large to small and
puts each where the dot product of its vector with the shards' residual capacity is highest. Groups stay whole; only
one of more than a shard's fair share, or one that keeps bytes from being even, is cut into slices by document. The
documents then get their parcel's shard by join.

Null and empty texts have 0 tokens and, as every text does, 1 byte more than their own. Equal rows are all kept, in the
same group. A very long text is one row of its size, whose parcel is packed early. Of shards with equal scores the one
with the smallest number is taken. Null ids come first in a shard's order, equal ids by checksum; an id with more rows than a range of ids
(null, say) is in pieces of near equal rows, each in order of checksum. Other columns are not
read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import bucket_of, nat, staged

#: A token, for balance: a word between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Parcels that light groups are hashed into; slices that a heavy group may be cut into.
PARCELS, SLICES = 4096, 64
#: A group of two rows or more is heavy if it holds more than this share of all bytes, tokens or rows: 3 / HEAVY groups at most.
HEAVY = 1 / 2000
#: A heavy group is cut if it holds more than this part of a shard's fair share; the part is halved until bytes are even.
WHOLE = 1
#: Pieces that the rows of an id are numbered in where they are more than a range.
PIECES = 64


def measured(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"),
        F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SLICES)).cast("int").alias("slice"),
    )


def pack(load: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row of `load` (parcels x dimensions): largest first, to the highest dot product with what is left.

    Capacities are the fair shares, and all dimensions are scaled to them. A shard without room for a parcel in some
    dimension is taken only if all lack it.
    """
    total = load.sum(axis=0)
    scaled = load / np.maximum(total, 1) * shards
    left = np.ones((shards, load.shape[1]))
    out = np.zeros(len(load), int)
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        v = scaled[i]
        fits = (left >= v).all(axis=1)
        score = left @ v
        if fits.any():
            score = np.where(fits, score, -np.inf)
        else:
            # The last parcels overfill a little: bytes lead, then the rest.
            score = left[:, 0]
        out[i] = int(np.argmax(score))
        left[out[i]] -= v
    return out


def placed(loads: np.ndarray, parcel: np.ndarray, shards: int, largest: int) -> np.ndarray:
    """The shard of each row of `loads` (parcels, heavy ones in slices): slices go together as far as packing stays fine.

    `largest` is the size of the largest document. Bytes are even once shards differ by no more than that or a hundredth.
    """
    names, of = np.unique(parcel, return_inverse=True)
    whole = np.zeros((len(names), loads.shape[1]))
    np.add.at(whole, of, loads)
    share = (whole / np.maximum(loads.sum(axis=0), 1)).max(axis=1) * shards
    sliced = np.bincount(of) > 1
    limit = WHOLE
    while True:
        cut = sliced & (share > limit)
        # Rows of one item have one number: their parcel's, or their own.
        item, at = np.unique(np.where(cut[of], len(names) + np.arange(len(of)), of), return_inverse=True)
        size = np.zeros((len(item), loads.shape[1]))
        np.add.at(size, at, loads)
        shard = pack(size, shards)
        filled = np.bincount(shard, weights=size[:, 0], minlength=shards)
        if np.ptp(filled) <= max(largest, 0.01 * filled.mean()) or (cut == sliced).all():
            return shard[at]
        limit /= 2


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """rows with a column shard. rows: measured()."""
    spark = rows.sparkSession
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "tokens")]
    total = rows.agg(*sums, F.count("*").alias("rows"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).first()
    vector = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    too_much = (F.col("size") > HEAVY * total["size"]) | (F.col("tokens") > HEAVY * total["tokens"]) | (F.col("rows") > HEAVY * total["rows"])
    # Counted map-side; at most 3 / HEAVY groups are heavy.
    heavy = sorted(r["group"] for r in rows.groupBy("group").agg(*vector).filter(too_much & (F.col("rows") > 1)).select("group").collect())
    own = spark.createDataFrame([(g, PARCELS + i) for i, g in enumerate(heavy)], T.StructType.fromDDL("group long, own int"))
    light = F.pmod("group", F.lit(PARCELS)).cast("int")
    dealt = rows.join(F.broadcast(own), "group", "left").withColumn("slice", F.when(F.col("own").isNull(), -1).otherwise(F.col("slice")))
    dealt = dealt.withColumn("parcel", F.coalesce("own", light)).drop("own", "group")
    # At most PARCELS + 3 / HEAVY * SLICES rows of five numbers, whatever the number of documents.
    loads = dealt.groupBy("parcel", "slice").agg(*vector).toPandas().sort_values(["parcel", "slice"])
    shard = placed(loads[["size", "tokens", "rows"]].to_numpy(float), loads["parcel"].to_numpy(), shards, total["largest"]) if len(loads) else []
    schema = T.StructType.fromDDL("parcel int, slice int, shard int")
    found = spark.createDataFrame([(int(p), int(s), int(x)) for p, s, x in zip(loads["parcel"], loads["slice"], shard)], schema)
    return dealt.join(F.broadcast(found), ["parcel", "slice"])


def with_slots(rows: DataFrame, ranges: int = 256) -> DataFrame:
    """rows with `slot`: 0, 1, ... within each shard, in ascending doc_id. Ranges of ids are numbered apart and then offset.

    `tie`, a number of the row's own, deals the rows of an id that fills ranges into pieces. It must not change between reads.
    """
    keyed = rows.withColumn("__id", nat("doc_id"))
    at = [i / ranges for i in range(1, ranges)]
    cuts = keyed.agg(F.percentile_approx("__id", at, 20 * ranges).alias("b")).first()["b"] or []
    # An id that holds more than a range's rows is a cut twice, or nearly so: half as many as ranges at most.
    hot = sorted({a for a, b in zip(cuts, cuts[1:]) if a == b})
    piece = F.when(F.col("__id").isin(hot), F.pmod("tie", F.lit(PIECES))).otherwise(0).cast("int") if hot else F.lit(0)
    # A hot id begins a range, so that what shares its range comes before or after all its pieces.
    bounds = sorted({*cuts, *(h - 1 for h in hot if h > -(1 << 63))})
    keyed = keyed.withColumn("__range", bucket_of(F.col("__id"), bounds)).withColumn("__piece", piece)
    counts = keyed.groupBy("shard", "__range", "__piece").agg(F.count("*").alias("__n"))
    # At most 2 * ranges + PIECES / 2 * ranges rows a shard.
    before = Window.partitionBy("shard").orderBy("__range", "__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__range", "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__range", "__piece").orderBy("__id", "text_crc32", "tie")
    numbered = keyed.withColumn("__k", F.row_number().over(within) - 1)
    met = numbered.join(F.broadcast(starts), ["shard", "__range", "__piece"])
    return met.withColumn("slot", (F.col("__start") + F.col("__k")).cast("long"))


def sharded(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, tokens, text_crc32, shard and slot of every document."""
    rows = staged(measured(docs).withColumn("tie", F.xxhash64(F.monotonically_increasing_id())), "shard-measures")
    return with_slots(assign(rows, shards)).select("doc_id", "size", "tokens", "text_crc32", "shard", "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 8 shards under the law `bytes`: sizes near equal."""
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
