"""Operator 13 against a trie of dictionaries, and its range minima against plain loops."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, block int, keys string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    children = {}
    for x in members:
        if x:
            children.setdefault(x[:-1], []).append(x)
    total = {}
    for x in sorted(members, key=len, reverse=True):
        saved = (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
        below = [total[y] for y in children.get(x, [])]
        total[x] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
    out = set()
    for x, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(x))
        out.add((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children.get(x, [])), *total[x], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def held(df, rows):
    got = [tuple(r) for r in trie.prefix_trie(df).select(*COLUMNS).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain(rows)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash", 7, "clash") for r in rows], SCHEMA).repartition(parts)


def test_given_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    held(turns, [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", range(4))
def test_intervals_over_many_blocks(spark, seed):
    """Few words, so that prefixes are shared over blocks of a few rows each: up to 24 blocks."""
    r = random.Random(seed)
    rows = []
    for c in range(400):
        start = [("u", "a"), ("v", "é"), ("u", "long")] * (2 if seed % 2 else 1) if r.random() < 0.6 else []
        rows += [(c * (1 if seed < 2 else -3), t, *x) for t, x in enumerate(start + [(r.choice("uv"), r.choice("ab")) for _ in range(r.randint(1, 6))])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(4 + 20 * (seed % 2)))
    try:
        held(table(spark, rows), rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_odd_rows(spark):
    rows = [
        (0, 1, "u", "hello"), (0, None, None, None), (0, None, "s", "x"), (0, 1, "u", "hello"), (0, 1, "a", "tie"), (1, 0, "u", None), (2, 5, "", ""), (3, 2, None, "é" * 30000), (3, 1, "r", "a,b"),
        (None, 1, "u", "nobody's"), (7, 0, "u", "only"), (-3, 0, "u", "below"), (-5, 1, "u", "below"), (1 << 60, 9, "u", "far"), (12, 0, "ab", "c"), (13, 0, "a", "bc"), (13, 0, "a", "bc"),
    ]
    held(table(spark, rows), rows)
    held(table(spark, rows * 2), rows * 2)


def test_copies_and_one_deep_conversation(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 1500, 5) for t in range(3)] + [(5000, t, "u", f"t{t}") for t in range(2000)] + [(5001, t, "u", f"t{t}") for t in range(1500)]
    held(table(spark, rows), rows)


def test_empty_table(spark):
    assert trie.prefix_trie(table(spark, [])).count() == 0
    assert trie.prefix_trie(table(spark, [(None, 1, "u", "x")])).count() == 0


def test_turnless_conversation_is_the_root(spark):
    c = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "u", "x")]
    held(table(spark, rows), rows)
    held(table(spark, rows + [(c + 5, t, "u", "y") for t in range(12)]), rows + [(c + 5, t, "u", "y") for t in range(12)])


def test_packets_of_ids_stream_in_order(spark, monkeypatch):
    monkeypatch.setattr(trie, "PACKET", 40)
    rows = spark.range(1000).select((F.col("id") * 7 - 3000).alias("conv_id"), F.lit(b"k" * 20).alias("keys"))
    [got] = trie.sequences(rows.repartition(5)).collect()
    ids = ",".join(str(i * 7 - 3000) for i in range(1000))
    assert (got["n"], got["least"], bytes(got["ends"])) == (1000, -3000, hashlib.sha256(ids.encode()).digest())


def test_range_minima():
    r = np.random.default_rng(0)
    v = r.integers(0, 6, 75)
    levels = trie.sparse_table(v)
    at, depth = np.repeat(np.arange(75), 7), np.tile(np.arange(7), 75)
    for i, d, right, left in zip(at, depth, trie.right_extent(levels, at, depth), trie.left_extent(levels, at, depth)):
        j = i
        while j + 1 < 75 and v[j + 1] >= d:
            j += 1
        k = i
        while k >= 0 and v[k] >= d:
            k -= 1
        assert (right, left) == (j, k)
    lo, hi = np.triu_indices(76)
    assert trie.range_min(levels, lo, hi, 99).tolist() == [v[a:b].min(initial=99) for a, b in zip(lo, hi)]
