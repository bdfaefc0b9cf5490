"""Near-duplicate classes by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles. On the circle of shingle hashes, the minwise token at a point is the
first of the set's hashes from there on: two sets have the same one with a probability equal to their similarity.
Each tree opens at a point of its own, where documents with the same token form a node. A small node is compared
exhaustively. A large one branches: its path chooses BRANCHES further points, and documents go on by their tokens
there, until nodes are small. TREES independent trees find a pair at the threshold of 0.75 with a probability of
1 - 0.25 ** 16 where nodes are small; in branching ones a path survives with 8/9, so that 2e-8 of such pairs are missed.
A large node most of which goes on together at every point chosen, or that is still large after DEPTH levels, holds
documents that tokens don't tell apart. It is dealt in blocks, first around one of its documents. What is then not in
its main class meets all others once, in a triangle of cells of two blocks each: every pair has exactly one cell, and
no cell holds more than about SMALL documents. A pair in several such nodes, of whichever trees, is compared in the first
alone: each document carries those before the node at hand. Sketches drop documents without a likely partner before
texts travel.

Equal sets are one class from the start and are represented by one document, so copies cost nothing further. Sketches
decide which documents of a node need a comparison; links are confirmed on full sets of 64-bit shingle hashes, and a
pair that is connected already is not compared again. Nodes stream from sorted partitions: a task holds one node at a
time. Classes follow from links by alternating star contraction in joins. What holds once for a node or a class (its
size, its first document, its smallest neighbour) comes to the rows of common ones by broadcast of a bounded table.

Words: A-Z lower-cased, split at ASCII blanks. Texts of fewer than five words are one shingle; null and empty texts
have no set and no links. Different texts under one doc_id (null ids, say) are documents of their own, told apart by a
digest; equal rows are one document. A null id comes before all others. Of a class the row with the smallest id stays,
of equal ids that with the smallest digest. A very long text counts for several in a node's size. Other columns are not
read and may have any names (`deduplicated` keeps them). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import discard, joined_by, nat, parts, slices, staged, text_bytes
from corvane.llm.words import BLANK, LOWER, Rolling, mix, word_hashes, word_spans

SHINGLE, NEED = 5, 75
#: Points that a sketch looks at, and those of them that open trees.
POINTS, TREES = 128, 16
#: Sets of up to so many shingles also form nodes by every single token: pairs of them share one for certain.
TINY = 16
#: Documents of a small node, points that a large one branches at, and levels of branching.
SMALL, BRANCHES, DEPTH = 600, 2, 8
#: Shingles of a document that counts for two in a node's size.
LONG = 2048
#: Which pairs of a cell are compared: all, or those of one side with those of the other.
LEFT, RIGHT, BOTH = range(3)
NULL_ID = -(1 << 63)


def sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, at = text_bytes(column)
    low = LOWER[buf]
    starts, ends, first = word_spans(low, at, ~BLANK)
    words = word_hashes(low, starts, ends)
    out = []
    i = 0
    while i < len(first) - 1:
        # Neighbouring texts share one pass, so that powers stay small.
        j = max(i + 1, int(np.searchsorted(first, first[i] + (1 << 19), side="right")) - 1)
        j = min(j, len(first) - 1)
        base = first[i]
        roll = Rolling(words[base : first[j]])
        grams = roll.grams(SHINGLE)
        for d in range(i, j):
            a, b = int(first[d] - base), int(first[d + 1] - base)
            if b - a >= SHINGLE:
                out.append(np.unique(grams[a : b - SHINGLE + 1]))
            elif b > a:
                out.append(roll.span(np.array([a]), np.array([b])))
            else:
                out.append(np.zeros(0, np.uint64))
        i = j
    return out


AT = np.arange(POINTS, dtype=np.uint64) << np.uint64(64 - 7)


def sketch(s: np.ndarray) -> np.ndarray:
    """The low bits of the minwise token at every point."""
    spot = np.searchsorted(s, AT)
    spot[spot == len(s)] = 0
    return s[spot].astype(np.uint32)


def likely(n: np.ndarray) -> np.ndarray:
    """Equal places of two sketches from which sets of n shingles (the smaller) are compared: 4.5 standard deviations below what 0.75 gives."""
    return POINTS * (0.75 - 4.5 * np.sqrt(0.75 * 0.25 * (1 / POINTS + 1 / (n + 1))))


def described(docs: DataFrame) -> DataFrame:
    """id, sub (digest of the text), n (shingles), h1, h2 (together with n: equal only for equal sets), tokens (for trees) and sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                own = sets(part.column("text"))
                looks = [sketch(s) if len(s) else None for s in own]
                step = POINTS // TREES
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "sub": part.column("sub"),
                        "n": pa.array([len(s) for s in own], pa.int64()),
                        "h1": pa.array([int(s.sum().view(np.int64)) if len(s) else 0 for s in own], pa.int64()),
                        "h2": pa.array([int(mix(s).sum().view(np.int64)) if len(s) else 0 for s in own], pa.int64()),
                        "tokens": pa.array([None if x is None else np.concatenate([x[::step], s.astype(np.uint32) if len(s) <= TINY else x[:0]]).view(np.int32) for x, s in zip(looks, own)], pa.list_(pa.int32())),
                        "sketch": pa.array([None if x is None else x.astype(np.uint16).tobytes() for x in looks], pa.binary()),
                    }
                )

    rows = docs.select(nat("doc_id").alias("id"), _digest().alias("sub"), "text")
    return rows.mapInArrow(run, "id long, sub long, n long, h1 long, h2 long, tokens array<int>, sketch binary")


def _digest() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _live(rows: DataFrame, total: int) -> DataFrame:
    """Of `total` rows (tree, node, key, units), those of the nodes with two documents or more, with m, the sum of their units."""
    counts = rows.groupBy("node").agg(F.sum("units").alias("m"), F.count("*").alias("places")).filter("places > 1")
    return joined_by(rows, counts, ["node"], total)


def nodes(reps: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(tree, node, key, units, m) of the documents in small nodes, and in large ones that branching doesn't part; and the staged tables."""
    units = F.expr(f"1 + n div {LONG}").alias("units")
    opened = reps.select("key", units, F.posexplode("tokens").alias("at", "token")).select("key", "units", F.least("at", F.lit(TREES)).alias("tree"), "token")
    level = staged(_live(opened.select("tree", F.xxhash64("tree", "token").alias("node"), "key", "units"), TREES * reps.count()), "near-nodes")
    used, small, whole = [level], [level.filter(F.col("m") <= SMALL)], []
    for _ in range(DEPTH):
        large = level.filter(F.col("m") > SMALL)
        if large.isEmpty():
            break
        points = F.array(*[F.pmod(F.xxhash64("node", F.lit(j)), F.lit(POINTS)).cast("int") for j in range(BRANCHES)])
        held = large.join(reps.select("key", "sketch"), "key").withColumn("point", F.explode(points))
        token = F.substring(F.col("sketch"), 2 * F.col("point") + 1, F.lit(2))
        child = staged(held.select("tree", F.col("node").alias("parent"), "m", "point", F.xxhash64("node", "point", token).alias("node"), "key", "units"), "near-branches")
        # Where most of a node goes on together at every point its documents are near copies, or share most of a template.
        sizes = child.groupBy("parent", "m", "point", "node").agg(F.sum("units").alias("n"))
        kept = sizes.groupBy("parent", "m", "point").agg(F.max("n").alias("n")).groupBy("parent", "m").agg(F.min("n").alias("n"))
        dense = kept.filter("2 * n > m").select("parent")
        whole.append(large.join(dense.withColumnRenamed("parent", "node"), "node", "left_semi"))
        level = staged(_live(child.join(dense, "parent", "left_anti").select("tree", "node", "key", "units"), child.count()), "near-nodes")
        used += [child, level]
        small.append(level.filter(F.col("m") <= SMALL))
    whole.append(level.filter(F.col("m") > SMALL))
    large = staged(_union(whole), "near-whole")
    return _union(small), large, [*used, large]


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select("tree", "node", "key", "units", "m") for f in frames])


def _streamed(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """work on tables of whole nodes, of which a task holds the ones of a batch or else one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            last = int(np.searchsorted(node, node[-1]))
            if last or (held and held[-1].column("node")[0].as_py() != node[0]):
                if last:
                    held.append(batch.slice(0, last))
                yield from work(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(batch.slice(last))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return rows.repartition(parts(rows.sparkSession), "node").sortWithinPartitions("node").mapInArrow(run, schema)


def marks(node: np.ndarray, before: pa.Array) -> np.ndarray:
    """The values of each row's list as bits: two rows of one node share a value where they share a bit. As many words a row as the values of a node need."""
    row = np.repeat(np.arange(len(node)), pc.fill_null(pc.list_value_length(before), 0).to_numpy(zero_copy_only=False))
    if not len(row):
        return np.zeros((len(node), 0), np.uint64)
    value = before.flatten().to_numpy(zero_copy_only=False)
    order = np.lexsort((value, node[row]))
    row, value = row[order], value[order]
    opens = np.concatenate([[True], node[row[1:]] != node[row[:-1]]])
    number = np.cumsum(opens | np.concatenate([[True], value[1:] != value[:-1]])) - 1
    number -= number[np.flatnonzero(opens)][np.cumsum(opens) - 1]
    out = np.zeros((len(node), int(number.max()) // 64 + 1), np.uint64)
    np.bitwise_or.at(out, (row, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    return out


def _active(rows: DataFrame) -> DataFrame:
    """Of the rows (tree, node, key, label, side, before, n, sketch), those with a likely partner of another class in their node, without n and sketch.

    Partners that share one of the nodes in `before` don't count.
    """

    def look(table: pa.Table) -> pa.Table:
        node, n, label, side = (table.column(c).to_numpy() for c in ("node", "n", "label", "side"))
        looks = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, POINTS)
        seen = marks(node, table.column("before").combine_chunks())
        found = np.zeros(len(node), bool)
        left = np.arange(len(node))
        step = 1
        while len(left := left[left + step < len(node)]) and len(left := left[node[left] == node[left + step]]):
            for i in range(0, len(left), 1 << 14):
                a = left[i : i + (1 << 14)]
                b = a + step
                near = (100 * np.minimum(n[a], n[b]) >= NEED * np.maximum(n[a], n[b])) & (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == BOTH))
                near &= ~(seen[a] & seen[b]).any(axis=1)
                a, b = a[near], b[near]
                near = (looks[a] == looks[b]).sum(axis=1) >= likely(np.minimum(n[a], n[b]))
                found[a[near]] = found[b[near]] = True
            step += 1
        return table.select(MEMBER).take(pa.array(np.flatnonzero(found)))

    return _streamed(rows, look, "tree int, node long, key long, label long, side int, before array<long>")


MEMBER = ["tree", "node", "key", "label", "side", "before"]


def _none() -> Column:
    return F.array().cast("array<long>").alias("before")


def _links(rows: DataFrame) -> DataFrame:
    """Confirmed links (a, b) that connect the documents of each node as far as they are not yet: rows are (node, key, label, side, before, text)."""

    def confirm(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node, keys, label, side = (table.column(c).to_numpy() for c in ("node", "key", "label", "side"))
        seen = marks(node, table.column("before").combine_chunks())
        out: list[tuple[int, int]] = []
        edges = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                text = table.column("text").slice(a, b - a).combine_chunks()
                out += compared(keys[a:b], label[a:b], side[a:b], seen[a:b], sets(text))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _streamed(rows, confirm, "a long, b long")


def compared(ids: np.ndarray, label: np.ndarray, side: np.ndarray, seen: np.ndarray, own: list[np.ndarray]) -> list[tuple[int, int]]:
    """The links of one small node or cell, but for those connected by then and those that share a bit of `seen`."""
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first: dict[int, int] = {}
    for i, x in enumerate(label.tolist()):
        parent[i] = first.setdefault(x, i)
    size = np.array([len(s) for s in own])
    looks = np.stack([sketch(s).astype(np.uint16) for s in own])
    out = []
    for i in range(len(ids) - 1):
        rest = slice(i + 1, None)
        near = (100 * np.minimum(size[i], size[rest]) >= NEED * np.maximum(size[i], size[rest])) & ((looks[rest] == looks[i]).sum(axis=1) >= likely(np.minimum(size[i], size[rest])))
        near &= ((side[rest] != side[i]) | (side[i] == BOTH)) & ~(seen[rest] & seen[i]).any(axis=1)
        for j in (np.flatnonzero(near) + i + 1).tolist():
            if root(i) == root(j):
                continue
            common = len(np.intersect1d(own[i], own[j], assume_unique=True))
            if 100 * common >= NEED * (size[i] + size[j] - common):
                parent[root(j)] = root(i)
                out.append((int(ids[i]), int(ids[j])))
    return out


def classes(links: DataFrame) -> DataFrame:
    """(key, label) of all keys in links (a, b): label is the smallest key reachable."""

    def smallest(edges: DataFrame, total: int) -> DataFrame:
        """`total` edges (u, v), and with each u the smallest of itself and its v's."""
        low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("places")).select("u", F.least("u", "m").alias("m"), "places")
        return joined_by(edges, low, ["u"], total)

    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "near-links")
    while True:
        # Done when every id hangs from one other that hangs from none.
        ends = F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        at = edges.select(F.inline(ends)).groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if at.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty():
            break
        before, total = edges, edges.count()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: what lies above u hangs from the smallest around u. Small star: what lies below does.
        large = staged(smallest(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "near-stars")
        low = smallest(large, total)
        small = low.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = staged(small.filter("u <> v").distinct(), "near-links")
        discard(before, large)
    roots = edges.select(F.col("v").alias("key"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("label")).unionByName(roots)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("label", F.col("key"))
    return rows.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))


def _mixed(rows: DataFrame, total: int) -> DataFrame:
    """Of `total` rows (node, key, label), those of nodes whose documents are not all of one class yet."""
    some = rows.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("places")).filter("lo <> hi")
    return joined_by(rows, some.select("node", "places", F.lit(True).alias("mixed")), ["node"], total).drop("mixed")


def around(rows: DataFrame) -> DataFrame:
    """rows (tree, node, key, label, units, m) of large nodes, dealt into blocks with one of the node's documents in all of them."""
    first = rows.groupBy("node").agg(F.min("key").alias("first"), F.count("*").alias("places"))
    count = F.ceil(2 * F.col("m") / SMALL).cast("int")
    own = F.array(F.pmod(F.xxhash64("key"), count).cast("int"))
    block = F.explode(F.when(F.col("key") == F.col("first"), F.sequence(F.lit(0), count - 1)).otherwise(own)).alias("block")
    held = joined_by(rows, first, ["node"], rows.count()).select("tree", "node", "key", "label", block)
    return held.select("tree", F.xxhash64("node", "block").alias("node"), "key", "label", F.lit(BOTH).alias("side"), _none())


def _earlier(rows: DataFrame) -> DataFrame:
    """rows (tree, node, key, ...) with `before`: the nodes of the same key among them that come before this one, in order.

    A document is in at most BRANCHES ** DEPTH nodes of a tree, mostly in one.
    """
    own = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("tree", "node"))).alias("all"))
    below = F.filter("all", lambda x: x < F.struct("tree", "node"))
    return rows.join(own, "key").withColumn("before", F.transform(below, lambda x: x["node"])).drop("all")


def cells(rows: DataFrame, used: list[DataFrame] | None = None) -> DataFrame:
    """rows as in around(), dealt into cells so that each pair of documents of different classes meets once, in the first node that holds both.

    A node's documents are in groups: its main class, those with the same first node before this one, and the rest (with
    groups too small for a block). Blocks hold half of SMALL. A cell (i, j) holds block i on one side and j on the other,
    or block i alone where i = j. Only the rest has cells within the group: the others' pairs are of one class or have met.
    Pairs whose common node is not the first of either are told apart by `before`. used: takes staged tables.
    """
    total = rows.count()
    held = staged(_earlier(rows), "near-held")
    if used is not None:
        used.append(held)
    per = held.groupBy("node", "label").agg(F.sum("units").alias("s"), F.count("*").alias("c"))
    main = per.groupBy("node").agg(F.max_by("label", F.struct("s", "label")).alias("main"), F.sum("c").alias("places"))
    held = joined_by(held, main, ["node"], total)
    is_main = F.col("label") == F.col("main")
    met = F.size("before") > 0
    held = held.withColumn("kind", F.when(is_main, 0).when(met, 1).otherwise(2)).withColumn("of", F.when(~is_main & met, F.get("before", F.lit(0))).otherwise(F.lit(0)))
    tally = held.groupBy("node", "kind", "of").agg(F.sum("units").alias("s"), F.count("*").alias("places"))
    little = (F.col("kind") == 1) & (2 * F.col("s") < SMALL)
    tally = tally.withColumns({"as_kind": F.when(little, 2).otherwise(F.col("kind")), "as_of": F.when(little, 0).otherwise(F.col("of"))})
    # A node has no more groups than blocks, but for two.
    groups = tally.groupBy("node", "as_kind", "as_of").agg(F.ceil(2 * F.sum("s") / SMALL).cast("int").alias("blocks"))
    of_node = Window.partitionBy("node")
    so_far = of_node.orderBy("as_kind", "as_of").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumns({"start": (F.sum("blocks").over(so_far) - F.col("blocks")).cast("int"), "all": F.sum("blocks").over(of_node).cast("int")})
    spots = tally.join(groups, ["node", "as_kind", "as_of"]).select("node", "kind", "of", "places", "as_kind", "blocks", "start", "all")
    held = joined_by(held, spots, ["node", "kind", "of"], total)
    held = held.withColumn("own", F.col("start") + F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    outside = lambda j: (F.col("as_kind") == 2) | (j < F.col("start")) | (j >= F.col("start") + F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), outside)
    side = lambda j: F.when(j == F.col("own"), BOTH).when(j < F.col("own"), RIGHT).otherwise(LEFT)
    cell = lambda j: F.struct(F.least(j, F.col("own")).alias("a"), F.greatest(j, F.col("own")).alias("b"), side(j).alias("side"))
    out = held.select("tree", "node", "key", "label", "before", F.explode(F.transform(others, cell)).alias("c"))
    return out.select("tree", F.xxhash64("node", "c.a", "c.b").alias("node"), "key", "label", "c.side", "before")


def near_classes(docs: DataFrame) -> DataFrame:
    """id (doc_id, null as the smallest long), sub, n_shingles, component (its smallest id) and first (whether the row is the one that stays) of every document."""
    rows = staged(described(docs), "near-described")
    own = F.min_by(F.struct("id", "sub", "tokens", "sketch"), F.struct("id", "sub")).alias("own")
    reps = rows.filter("n > 0").groupBy("h1", "h2", "n").agg(own, F.count("*").alias("places")).select("h1", "h2", "n", "places", "own.*")
    reps = staged(reps.withColumn("key", F.monotonically_increasing_id()), "near-reps")
    small, large, used = nodes(reps)
    looks = reps.select("key", "n", "sketch")
    first = small.select("tree", "node", "key", F.col("key").alias("label"), F.lit(BOTH).alias("side"), _none())
    active = staged(_active(first.join(looks, "key")).drop("label"), "near-active")
    wanted = active.select("key").unionByName(large.select("key")).distinct().join(reps.select("key", "id", "sub"), "key")
    texts = docs.select(nat("doc_id").alias("id"), _digest().alias("sub"), "text").join(wanted, ["id", "sub"])
    texts = staged(texts.groupBy("id", "sub").agg(F.first("key").alias("key"), F.first("text").alias("text")).select("key", "text"), "near-texts")
    labels: DataFrame | None = None
    used += [active, texts]
    n_active, n_large = active.count(), large.count()
    for last in (False, True):
        # The first tree connects most; then all trees, but only nodes that still hold several classes.
        few = _mixed(_labelled(active if last else active.filter("tree = 0"), labels), n_active).select(MEMBER)
        crowd = staged(_mixed(_labelled(large if last else large.filter("tree = 0"), labels), n_large), "near-crowd")
        dealt = cells(crowd, used) if last else around(crowd)
        rest = staged(_active(dealt.join(looks, "key")), "near-cells")
        found = _links(few.unionByName(rest).join(texts, "key").select("node", "key", "label", "side", "before", "text"))
        if labels is not None:
            found = found.unionByName(labels.select(F.col("key").alias("a"), F.col("label").alias("b")))
        labels = classes(found)
        used += [crowd, rest]
    named = staged(reps.select("key", "id", "sub").join(labels, "key"), "near-named")
    best = named.groupBy("label").agg(F.min(F.struct("id", "sub")).alias("best"), F.count("*").alias("places"))
    linked = staged(joined_by(named, best, ["label"], named.count()).select("key", "best"), "near-classes")
    discard(*used, named)
    mine = F.struct("id", "sub")
    ours = staged(reps.join(linked, "key", "left").select("h1", "h2", "n", "places", F.coalesce("best", mine).alias("best")), "near-sets")
    told = rows.select("id", "sub", "n", "h1", "h2")
    out = joined_by(told.filter("n > 0"), ours, ["h1", "h2", "n"], told.count())
    out = out.unionByName(told.filter("n = 0").withColumn("best", mine))
    return out.select("id", "sub", F.col("n").alias("n_shingles"), F.col("best.id").alias("component"), (F.col("best") == mine).alias("first"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, with one document of each class: that with the smallest doc_id. Rows that repeat one wholly go, too."""
    classed = staged(near_classes(docs).select(F.col("id").alias("__id"), F.col("sub").alias("__sub"), "first", "n_shingles"), "near-verdicts")
    inner = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"__c{i}") for i, c in enumerate(docs.columns)}
    keyed = inner.withColumns({"doc_id": at["doc_id"], "text": at["text"]}).withColumns({"__id": nat("doc_id"), "__sub": _digest()}).drop("doc_id", "text")
    key = ["__id", "__sub"]
    left = keyed.join(classed.filter("not first").select(*key).distinct(), key, "left_anti")
    again = staged(classed.filter("n_shingles > 0").groupBy(*key).agg(F.count("*").alias("c")).filter("c > 1").select(*key), "near-again")
    if not again.isEmpty():
        once = left.join(again, key, "left_semi").dropDuplicates(key)
        left = left.join(again, key, "left_anti").unionByName(once)
    return left.select(*inner.columns).toDF(*docs.columns)


def op5_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    given = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(given("id").alias("doc_id"), "n_shingles", given("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))
