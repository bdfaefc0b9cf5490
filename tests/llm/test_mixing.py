"""Operator 11 against plain apportionment, plain resharing and a count of the mix itself."""

import heapq
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, bucket int, target string, key int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / free for s in names}
        over = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not over:
            return out
        capped |= over


def plain_seats(wanted, limit, house):
    given = [0] * len(wanted)
    heap = [(-w, i) for i, w in enumerate(wanted) if limit[i]]
    heapq.heapify(heap)
    for _ in range(house):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        given[i] += 1
        if given[i] < limit[i]:
            heapq.heappush(heap, (-wanted[i] / (2 * given[i] + 1), i))
    return given


def checked(docs, rows, **options):
    """mixed() of docs, held against the contract."""
    got = [tuple(r) for r in mixing.mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken").collect()]
    assert sorted(map(str, got)) == sorted(map(str, (tuple(r) for r in mixing.mixed(docs, **options).select("doc_id", "size", "source_size", "target", "taken").collect())))
    size = lambda t: len(WORDS.findall(t or ""))
    assert Counter((d, n) for d, n, *_ in got) == Counter((d, size(t)) for d, t, *_ in rows)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += size(t)
    want = plain_targets(sizes) if rows else {}
    told = {round(t, 6) for *_, t, _ in got}
    assert {t for t in told} == {round(t, 6) for t in want.values()}
    assert all(0 <= k <= 2 * n for _, n, _, _, k in got)
    return got, want, sizes


def test_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    got, want, sizes = checked(docs, rows)
    source = {d: s for d, _, s in rows}
    taken = Counter()
    for d, _, n, t, k in got:
        assert n == sizes[source[d]] and t == pytest.approx(want[source[d]])
        taken[source[d]] += k
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.02)


def test_the_mix_holds_what_is_taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = mixing.pieces(docs, shard_blocks=50).toPandas()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mixed(docs).collect()}
    assert {d: n for d, n in taken.items() if n} == pieces.groupby("doc_id")["words"].sum().to_dict()
    # Shards hold as many blocks each, and a block is in a shard as a whole, once for each award.
    awards = pieces.drop_duplicates(["source", "award"]).groupby("shard").size()
    assert set(awards.iloc[:-1]) == {50} and 0 < awards.iloc[-1] <= 50
    assert (pieces.groupby(["source", "award"], dropna=False)["shard"].nunique() == 1).all()
    assert (pieces.groupby(["source", "award"], dropna=False)["words"].sum() <= mixing.BLOCK).all()


@pytest.mark.parametrize("shard_blocks", [1, 7, 1000])
def test_seats_are_those_of_highest_quotients(spark, shard_blocks):
    wanted, limit = [40.5, 13.2, 13.2, 0.4, 7.9, 3.0, 22.0], [90, 14, 30, 1, 8, 3, 22]
    table = spark.createDataFrame([(f"k{i}", i, w, n) for i, (w, n) in enumerate(zip(wanted, limit))], "key string, rank int, wanted double, limit long")
    got = {(r["key"], r["shard"]): (r["seats"], r["quota"]) for r in mixing.apportioned(table, shard_blocks).collect()}
    house = round(sum(wanted))
    before = [0] * len(wanted)
    for shard in range(-(-house // shard_blocks)):
        seats = plain_seats(wanted, limit, min(house, (shard + 1) * shard_blocks))
        for i, n in enumerate(seats):
            assert got[f"k{i}", shard] == (n, n - before[i])
        before = seats


def test_odd_rows(spark):
    r = [
        (0, None, "a", "x", 1, "t", 1), (1, "", "a", None, 1, "t", 1), (2, "one two three", "a", None, 1, "t", 1), (2, "one two three", "a", None, 1, "t", 1), (2, "other words here now", "b", None, 1, "t", 1),
        (None, "no id", "b", None, 1, "t", 1), (None, "nor this one", None, None, None, None, None), (5, "w " * 30000, None, None, None, None, None), (6, "x" * 30000, "\U0001f600", None, None, None, None), (7, "\x85 \x1c", "", None, None, None, None), (8, " \t\n", "only blank", None, None, None, None),
    ]
    docs = spark.createDataFrame(r + r[2:3] * 50, SCHEMA).repartition(3)
    got, want, _ = checked(docs, r + r[2:3] * 50)
    assert sum(k for *_, k in got) == pytest.approx(sum(want.values()), rel=0.05)
    assert {k for d, *_, k in got if d in (0, 1, 8)} == {0}


def test_code_points_order_sources(spark):
    """U+E000 comes before U+1F600, though not in UTF-16; null comes last."""
    docs = spark.createDataFrame([(i, "w " * 100, s) for i, s in enumerate(["\U0001f600", "", None, "z"])], "doc_id long, text string, source string")
    rank = {r["source"]: r["rank"] for r in mixing.targets(docs.select("source", F.coalesce("source", F.lit("")).alias("key"), F.lit(100).alias("source_size"))).collect()}
    assert rank == {"z": 1, "": 2, "\U0001f600": 3, None: 4}


def test_hot_source_is_split(spark):
    rows = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("some words of text").alias("text"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.format_string("s%d", F.col("id") % 9)).alias("source"))
    units = mixing.with_bucket(mixing.units(rows, 0), 30000)
    assert units.groupBy("key", "bucket").count().agg(F.max("count")).first()[0] < 3000
    total = mixing.mixed(rows).agg(F.sum("taken")).first()[0]
    assert total == pytest.approx(180000, rel=0.01)


def test_empty_table(spark):
    assert mixing.mixed(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = mixing.mixed(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0.0, 0)] * 2
