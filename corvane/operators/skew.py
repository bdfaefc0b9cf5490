"""Joins of rows with a table that has each key once, when some keys may hold a third of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is common: there are at most 1 / COMMON of them.
COMMON = 1 / 4096


def met(rows: DataFrame, table: DataFrame, keys: Sequence[str], places: Column, total: int) -> DataFrame:
    """The inner join of rows with `table` on keys. places: how many of the `total` rows have a key of the table.

    Common keys come to the rows by broadcast, 1 / COMMON rows at most; the rest meet by a shuffle without hot keys.
    """
    own = [c for c in table.columns if c not in keys]
    among = places > COMMON * total
    cells = F.struct(*[F.col(f"`{c}`") for c in own])
    marked = rows.join(F.broadcast(table.filter(among).select(*keys, cells.alias("__met"))), list(keys), "left")
    near = marked.filter("__met IS NOT NULL").select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"__met.`{c}`").alias(c) for c in own])
    far = marked.filter("__met IS NULL").drop("__met").join(table.filter(~among), list(keys))
    return near.unionByName(far)
