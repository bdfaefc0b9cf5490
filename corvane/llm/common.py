"""Helpers shared by the corpus operators: staged tables, ordered ranges and Arrow text batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.staging import discard, new_path, shared_dir, staged

__all__ = ["SLICE_BYTES", "bucket_of", "discard", "joined_by", "nat", "new_path", "parts", "range_bounds", "schema_of", "shared_dir", "slices", "staged", "text_bytes"]

#: Bytes of text that one numpy step works on at a time; bounds a task's memory.
SLICE_BYTES = 1 << 18


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def nat(column: str) -> F.Column:
    """A key column as a long that orders null before every other id."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63)))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """At most n - 1 cut points that deal the key's values into ranges of near equal count; one mergeable sketch a task."""
    at = [i / n for i in range(1, n)]
    cuts = df.agg(F.percentile_approx(key, at, 20 * n).alias("b")).first()["b"] if at else []
    return sorted(set(cuts or []))


#: A key with more than this share of all rows is common: there are at most 1 / COMMON of them.
COMMON = 1 / 4096


def joined_by(rows: DataFrame, table: DataFrame, key: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of `table`, which has each key once and, in `places`, how many of the `total` rows have it.

    Common keys come by broadcast, a table of 1 / COMMON rows at most; the rest meet by a shuffle without hot keys.
    """
    own = [c for c in table.columns if c not in key and c != "places"]
    among = F.col("places") > COMMON * total
    hot = table.filter(among).select(*key, F.struct(*own).alias("__own"))
    marked = rows.join(F.broadcast(hot), key, "left")
    met = marked.filter("__own IS NOT NULL").select(*rows.columns, "__own.*")
    rest = marked.filter("__own IS NULL").select(rows.columns).join(table.filter(~among).select(*key, *own), key, how)
    return met.unionByName(rest)


def bucket_of(key: F.Column, bounds: list[int]) -> F.Column:
    """How many of the sorted bounds lie below the key: its range's number."""
    if not bounds:
        return F.lit(0)
    b = F.array(*[F.lit(x).cast("long") for x in bounds])
    # Binary search over the literal bounds, as many steps as their number needs.
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.element_at(b, F.least(mid + 1, F.lit(len(bounds)))) < key
        done = s["lo"] >= s["hi"]
        return F.struct(
            F.when(~done & below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(~done & ~below, mid).otherwise(s["hi"]).alias("hi"),
        )

    return F.aggregate(steps, start, halve, lambda s: s["lo"])


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold about `limit` bytes; one longer text makes a run of its own."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    i, base = 0, 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(i, j - i)
        i, base = j, int(size[j - 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more offset at the end). Null: empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return buf, at - at[0]


def schema_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
