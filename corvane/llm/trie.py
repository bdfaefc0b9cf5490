"""Conversation prefix trie from sorted turn sequences, with range minima over their common prefixes.

A turn becomes a key of 20 bytes (128 bits of hash of role and text, and the text's UTF-8 bytes), a conversation the row of
its keys. Equal conversations collapse first. The distinct rows are sorted by ranges; a range is a block that tasks work
on. Within a block, adjacent rows have a longest common prefix (LCP); a sparse table holds the LCPs' minima over all powers
of two, and the prefix of depth d of row i reaches as far left and right as no LCP lies below d. Both extents are found
by binary search on the table, each by itself and all candidates at once; no stack walks the rows. What a node is told by
(members, smallest member, leaves, children) comes from its interval: prefix sums, a sparse table of the smallest ids, and
counts of LCPs equal to d.

An interval may leave its block. Of each block a summary is kept: its totals, its least LCP, and its stairs, the
places from either end where the LCP falls below all before, with what has been summed up there (as many as the
conversations are deep, at most). The same search on a sparse table over the blocks finds the block in which an interval
ends; its stairs tell where. Only summaries (a few numbers a block of some million turns) pass the driver. Sums over subtrees
need the members of all nodes first, so they are finished by a second such summary.

Two sequences are told apart by 128 bits. Turns are ordered by turn (null first), equal turns by role and text; null role
or text is empty. Repeated rows are turns of their own. A row without conv_id belongs to no conversation. c - c % 5 has
the remainder's sign of SQL, so -3 belongs to 0. A conversation without any turn left is a member of the root alone.
A conversation is one row of keys (some 50 million turns at most), a very long text is only hashed and counted. The ids of
a group of copies, however many, are streamed past a running digest in the order of ranges of ids. Other columns are not
read and may have any names. An empty table has no conversations, thus no root and no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bucket_of, discard, parts, range_bounds, staged

#: Bytes of a turn's key; turns of a block; conversations whose ids make one packet; conversations that share a head, and most turns of it and one.
KEY, BLOCK_TURNS, PACKET, FAMILY, HEAD = 20, 1 << 20, 1 << 20, 5, 9
EMPTY = hashlib.sha256(b"").digest()
BIG = (1 << 63) - 1


# Conversations as rows of keys.


def turn_key(role: Column, text: Column) -> Column:
    """The key of a turn; the role's length keeps role and text apart."""
    size = F.octet_length(text).cast("int")
    return F.concat(F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))), F.unhex(F.lpad(F.hex(size), 8, "0")))


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, keys) of turns (conv_id, turn, role, text). Texts stay in their tasks unless a conversation has a turn twice."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    tied = staged(rows.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).filter("n > 1").select("conv_id", F.col("turn").alias("at")), "trie-ties")
    told = rows.withColumn("key", turn_key(F.col("role"), F.col("text")))
    if not tied.isEmpty():
        mark = tied.select(F.col("conv_id").alias("c"), "at", F.lit(True).alias("there"))
        told = told.join(mark, (F.col("conv_id") == F.col("c")) & F.col("turn").eqNullSafe(F.col("at")), "left")
        among = F.when(F.col("there"), F.struct("role", "text"))
    else:
        among = F.lit(None).cast("struct<role:string,text:string>")
    own = told.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", among.alias("among"), "key"))).alias("turns"))
    return own.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")).alias("keys"))


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, keys): the first h turns of the family's first conversation, then what follows the own first h."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    families = own.groupBy(base.alias("base")).agg(F.collect_list(F.struct("conv_id", "keys")).alias("all"))
    first = F.get(F.filter("all", lambda c: c["conv_id"] == F.col("base")), 0)["keys"]
    each = families.select(F.coalesce(first, F.unhex(F.lit(""))).alias("head"), F.inline("all"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int") * KEY
    return each.select("conv_id", F.concat(F.substring("head", F.lit(1), h), F.substring("keys", h + 1, F.lit((1 << 31) - 1))).alias("keys"))


def sequences(rows: DataFrame) -> DataFrame:
    """(keys, n, least, ends) of the distinct rows of keys: members, the smallest, and the digest of all their ids.

    Ids come in packets by ranges of ids, which bounds each; a row of keys' packets stream past one running digest.
    """
    total = rows.count()
    ranged = rows.withColumn("range", bucket_of(F.col("conv_id"), range_bounds(rows, "conv_id", max(1, -(-total // PACKET), parts(rows.sparkSession)))))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    packets = ranged.groupBy("keys", "range").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), ids.alias("ids"))
    dealt = packets.repartition(parts(rows.sparkSession), "keys").sortWithinPartitions("keys", "range")

    def task(batches):
        key, n, least, digest = None, 0, BIG, None
        for batch in batches:
            out = []
            for k, more, low, text in zip(*(batch.column(c).to_pylist() for c in ("keys", "n", "least", "ids"))):
                if k != key:
                    if key is not None:
                        out.append((key, n, least, digest.digest()))
                    key, n, least, digest = k, 0, BIG, hashlib.sha256()
                elif n:
                    digest.update(b",")
                digest.update(text.encode())
                n, least = n + more, min(least, low)
            yield _sequence_rows(out)
        if key is not None:
            yield _sequence_rows([(key, n, least, digest.digest())])

    return dealt.mapInArrow(task, "keys binary, n long, least long, ends binary")


def _sequence_rows(rows: list) -> pa.RecordBatch:
    k, n, low, d = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(d, pa.binary())], ["keys", "n", "least", "ends"])


# Range minima.


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Minima over 2^k values from each place on, for every k that fits."""
    levels, step = [values], 1
    while 2 * step <= len(values):
        last = levels[-1]
        levels.append(np.minimum(last[: len(last) - step], last[step:]))
        step *= 2
    return levels


def range_min(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, none: int = BIG) -> np.ndarray:
    """Minima of the values from lo up to before hi."""
    n = hi - lo
    k = np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1
    out = np.full(len(lo), none, np.int64)
    for level in np.unique(k[n > 0]):
        at = (k == level) & (n > 0)
        out[at] = np.minimum(levels[level][lo[at]], levels[level][hi[at] - (1 << int(level))])
    return out


def right_extent(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The last place from `at` on that is reached over values of `depth` or more: values at + 1, at + 2, ..."""
    at, n = at.copy(), len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        fits = at + (1 << k) < n
        ok = np.zeros(len(at), bool)
        ok[fits] = levels[k][at[fits] + 1] >= depth[fits]
        at[ok] += 1 << k
    return at


def left_extent(levels: list[np.ndarray], at: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place that is reached back from `at` over values of `depth` or more: values at, at - 1, ...; -1 is before all."""
    at = at.copy()
    for k in range(len(levels) - 1, -1, -1):
        fits = at - (1 << k) >= -1
        ok = np.zeros(len(at), bool)
        ok[fits] = levels[k][at[fits] - (1 << k) + 1] >= depth[fits]
        at[ok] -= 1 << k
    return at


# Blocks.


def common_prefixes(cells: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keys that each row shares with the one before. cells: all keys one after the other; the first row's is 0."""
    at = np.concatenate([[0], np.cumsum(size)])
    both = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(len(both)), both)
    within = np.arange(both.sum()) - np.repeat(np.cumsum(both) - both, both)
    differ = np.flatnonzero((cells[at[row] + within] != cells[at[row + 1] + within]).any(1))
    rows, first = np.unique(row[differ], return_index=True)
    out = both.copy()
    out[rows] = within[differ[first]]
    return np.concatenate([[0], out]).astype(np.int64)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // KEY
    x, y = (np.frombuffer(s[: n * KEY], np.uint8).reshape(n, KEY) for s in (a, b))
    differ = (x != y).any(1)
    return int(differ.argmax()) if differ.any() else n


@dataclass
class Block:
    """A sorted run of distinct rows of keys. lcp: with the row before, in the block before too (-1: there is none)."""

    size: np.ndarray
    lcp: np.ndarray
    n: np.ndarray
    least: np.ndarray
    bytes: np.ndarray  # of each key's text, row after row
    leaf: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, before: int, after: int) -> Block:
        """before, after: what the first row shares with the one before the block, and the last with the one after it."""
        keys = table.column("keys").to_pylist()
        size = np.array([len(k) // KEY for k in keys], np.int64)
        cells = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
        lcp = common_prefixes(cells[:, :16].copy().view(np.uint64), size)
        lcp[0] = before
        following = np.append(lcp[1:], after)
        length = cells[:, 16:].copy().view(">u4").astype(np.int64).ravel()
        take = lambda c: table.column(c).to_numpy()
        return cls(size, lcp, take("n"), take("least"), length, following < size)

    def up_to(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(values)])


def stairs(lcp: np.ndarray) -> np.ndarray:
    """Places where the value lies below all before."""
    low = np.minimum.accumulate(lcp)
    return np.flatnonzero(np.append(True, low[1:] < low[:-1]))


def _summary(number: int, b: Block) -> dict:
    """What other blocks need to know of one."""
    front = stairs(b.lcp)
    back = len(b.lcp) - 1 - stairs(b.lcp[::-1])
    low = np.minimum.accumulate(b.least)
    end = np.minimum.accumulate(b.least[::-1])[::-1]
    before = lambda v: b.up_to(v)[front].tolist()
    stop = np.append(front[1:], len(b.lcp))
    return {
        "block": number, "members": int(b.n.sum()), "leaves": int(b.leaf.sum()), "least": int(b.least.min()), "lcp": int(b.lcp.min()), "ties": int((b.lcp == b.lcp.min()).sum()),
        "front_lcp": b.lcp[front].tolist(), "front_members": before(b.n), "front_leaves": before(b.leaf), "front_least": np.append(BIG, low)[front].tolist(),
        "front_ties": [int((b.lcp[i:j] == b.lcp[i]).sum()) for i, j in zip(front, stop)], "back_lcp": b.lcp[back].tolist(), "back_least": end[back].tolist(),
    }


SUMMARY = (
    "block int, members long, leaves long, least long, lcp long, ties long, front_lcp array<long>, front_members array<long>, front_leaves array<long>, front_least array<long>, "
    "front_ties array<long>, back_lcp array<long>, back_least array<long>"
)


class Outline:
    """All blocks' summaries in order, with sparse tables over them. Stairs are kept as rows of one length (-2: none)."""

    def __init__(self, summaries: list[dict]):
        self.blocks = np.array([s["block"] for s in summaries])
        take = lambda c: np.array([s[c] for s in summaries], np.int64)
        self.members, self.leaves = (np.concatenate([[0], np.cumsum(take(c))]) for c in ("members", "leaves"))
        self.lcp, self.low = sparse_table(take("lcp")), sparse_table(take("least"))
        order = np.lexsort((np.arange(len(summaries)), take("lcp")))
        self.tie_key, self.ties = take("lcp")[order] * (len(summaries) + 1) + order, np.concatenate([[0], np.cumsum(take("ties")[order])])
        self.front, self.back = {}, {}
        for own, side, names in ((self.front, "front", ("lcp", "members", "leaves", "least", "ties")), (self.back, "back", ("lcp", "least"))):
            wide = max(len(s[f"{side}_lcp"]) for s in summaries)
            for c in names:
                own[c] = np.array([s[f"{side}_{c}"] + [-2] * (wide - len(s[f"{side}_{c}"])) for s in summaries], np.int64)

    def step(self, side: dict, block: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The first stair of a block that lies below a depth."""
        return (side["lcp"][block] < depth[:, None]).argmax(1)

    def equal_between(self, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """How many LCPs of blocks lo up to before hi equal the depth, where none lies below it."""
        wide = len(self.blocks) + 1
        at = lambda x: self.ties[np.searchsorted(self.tie_key, depth * wide + x)]
        return np.where(hi > lo, at(hi) - at(lo), 0)


@dataclass
class Reach:
    """What intervals that go on after a block take of the later ones: up to block `stop`, and of that what its stair tells."""

    stop: np.ndarray  # place of the block they end in, or the number of blocks
    step: np.ndarray
    members: np.ndarray
    leaves: np.ndarray
    least: np.ndarray
    equal: np.ndarray


def reach_right(o: Outline, here: int, depth: np.ndarray) -> Reach:
    count = len(o.blocks)
    stop = right_extent(o.lcp, np.full(len(depth), here), depth) + 1
    lo = np.full(len(depth), here + 1)
    inside = stop < count
    block = np.where(inside, stop, 0)
    step = o.step(o.front, block, depth)
    part = lambda c, none: np.where(inside, o.front[c][block, step], none)
    members = o.members[stop] - o.members[lo] + part("members", 0)
    leaves = o.leaves[stop] - o.leaves[lo] + part("leaves", 0)
    least = np.minimum(range_min(o.low, lo, stop), part("least", BIG))
    # Before the stair, the block holds the depth itself only if the stair before it is that.
    last = np.maximum(step - 1, 0)
    tied = np.where(inside & (step > 0) & (o.front["lcp"][block, last] == depth), o.front["ties"][block, last], 0)
    return Reach(stop, np.where(inside, step, 0), members, leaves, least, o.equal_between(lo, stop, depth) + tied)


def least_left(o: Outline, here: int, depth: np.ndarray) -> np.ndarray:
    """The smallest id of the rows before a block that prefixes of these depths take in."""
    first = left_extent(o.lcp, np.full(len(depth), here - 1), depth)
    hi = np.full(len(depth), here)
    block = np.maximum(first, 0)
    part = np.where(first >= 0, o.back["least"][block, o.step(o.back, block, depth)], BIG)
    return np.minimum(range_min(o.low, first + 1, hi), part)


NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, own_saved long, ends binary, block int, stop int, step int"
)
SAVED = "block int, total long, front array<long>"


def _nodes(place: int, b: Block, ends: np.ndarray, o: Outline) -> tuple[dict, dict]:
    """The nodes whose first row lies in the block (own_saved: what their subtrees save in it), and what they save by stairs."""
    rows = len(b.size)
    levels, low = sparse_table(b.lcp), sparse_table(b.least)
    members, leaves = b.up_to(b.n), b.up_to(b.leaf)
    # Candidates: each row's prefixes that the row before doesn't have. The first row of all has the root, of depth 0, too.
    new = b.size - b.lcp
    row = np.repeat(np.arange(rows), new)
    depth = np.arange(new.sum()) - np.repeat(np.cumsum(new) - new, new) + b.lcp[row] + 1
    last = right_extent(levels, row, depth)
    n_convs, n_leaves = members[last + 1] - members[row], leaves[last + 1] - leaves[row]
    least = range_min(low, row, last + 1)
    by = np.lexsort((np.arange(rows), b.lcp))
    wide = rows + 1
    keyed = (b.lcp[by] + 1) * wide + by
    between = lambda lo, hi, d: np.searchsorted(keyed, (d + 1) * wide + hi) - np.searchsorted(keyed, (d + 1) * wide + lo)
    children = between(row + 1, last + 1, depth) + (b.size[row] > depth)
    on = np.flatnonzero(last == rows - 1)
    stop, step = np.full(len(row), place, np.int64), np.full(len(row), -1, np.int64)
    if len(on):
        r = reach_right(o, place, depth[on])
        n_convs[on] += r.members
        n_leaves[on] += r.leaves
        least[on] = np.minimum(least[on], r.least)
        children[on] += r.equal
        stop[on], step[on] = r.stop, r.step
    # Parents: the same row's prefix before, or, of a row's first new prefix, the one it shares with the row before.
    parent = np.concatenate([[0], least[:-1]])
    opens = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    shared = b.lcp[row[opens]]
    at = row[opens]
    left, right = left_extent(levels, at, shared), right_extent(levels, at, shared)
    own = range_min(low, np.maximum(left, 0), right + 1)
    out = np.flatnonzero(left < 0)
    if len(out):
        own[out] = np.minimum(own[out], least_left(o, place, shared[out]))
    out = np.flatnonzero(right == rows - 1)
    if len(out):
        own[out] = np.minimum(own[out], reach_right(o, place, shared[out]).least)
    parent[opens] = own
    # What a node saves itself, its deeper prefixes of the same row, and all nodes of the rows after it in its interval.
    cell = np.cumsum(b.size) - b.size
    text = np.where(depth > 0, b.bytes[np.minimum(cell[row] + depth - 1, max(len(b.bytes) - 1, 0))] if len(b.bytes) else 0, 0)
    saves = (n_convs - 1) * text
    upto = np.concatenate([[0], np.cumsum(saves)])
    node_end = np.cumsum(new)
    own_saved = upto[node_end[last]] - upto[:-1]
    front = stairs(b.lcp)
    ends_here = depth == b.size[row]
    nodes = {
        "conv_id": least, "depth": depth, "parent_conv_id": parent, "n_convs": n_convs, "n_children": children, "n_leaves": n_leaves, "own_saved": own_saved,
        "ends": [ends[i] if e else EMPTY for i, e in zip(row, ends_here)], "block": np.full(len(row), place, np.int32), "stop": stop.astype(np.int32), "step": step.astype(np.int32),
    }
    return nodes, {"block": place, "total": int(saves.sum()), "front": upto[(node_end - new)[front]].tolist()}


def _by_block(laid: DataFrame, work, schema: str) -> DataFrame:
    """work(block, sorted table) for each block, in one task each."""

    def task(key, table):
        number = key[0].as_py()
        names, rows = work(number, table.sort_by("keys"))
        return pa.Table.from_arrays(rows, names)

    return laid.groupBy("block").applyInArrow(task, schema)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of turns (conv_id, turn, role, text): see op13's columns."""
    spark = turns.sparkSession
    own = staged(rebuilt(conversations(turns)), "trie-rebuilt")
    distinct = staged(sequences(own), "trie-sequences")
    discard(own)
    size = distinct.agg(F.sum(F.octet_length("keys")).alias("b"), F.count("*").alias("n")).first()
    if not size["n"]:
        return spark.createDataFrame([], TRIE)
    wanted = max(1, min(size["n"], max(parts(spark), -(-int(size["b"]) // KEY // BLOCK_TURNS))))
    laid = staged(distinct.repartitionByRange(wanted, "keys").sortWithinPartitions("keys").withColumn("block", F.spark_partition_id()), "trie-blocks")
    discard(distinct)
    ends = laid.groupBy("block").agg(F.min("keys").alias("first"), F.max("keys").alias("last")).orderBy("block").collect()
    shared = [-1, *[_shared(bytes(a["last"]), bytes(b["first"])) for a, b in zip(ends, ends[1:])], -1]
    place = {r["block"]: i for i, r in enumerate(ends)}
    around = {r["block"]: (shared[i], shared[i + 1]) for i, r in enumerate(ends)}

    def outline(number, table):
        s = _summary(place[number], Block.of(table, *around[number]))
        return list(s), [pa.array([v], pa.list_(pa.int64()) if isinstance(v, list) else pa.int32() if k == "block" else pa.int64()) for k, v in s.items()]

    o = Outline([r.asDict() for r in _by_block(laid, outline, SUMMARY).orderBy("block").collect()])

    def nodes(number, table):
        own, saved = _nodes(place[number], Block.of(table, *around[number]), table.column("ends").to_numpy(), o)
        m = len(own["depth"])
        types = {"ends": pa.binary(), "block": pa.int32(), "stop": pa.int32(), "step": pa.int32()}
        # The block's last row tells what its nodes save, for nodes that end in it.
        columns = [pa.array([*own[c], None] if c == "ends" else np.append(own[c], 0), types.get(c, pa.int64())) for c in own]
        return [*own, "place", "total", "front"], [*columns, pa.array([None] * m + [saved["block"]], pa.int32()), pa.array([None] * m + [saved["total"]], pa.int64()), pa.array([None] * m + [saved["front"]], pa.list_(pa.int64()))]

    found = staged(_by_block(laid, nodes, f"{NODES}, place int, total long, front array<long>"), "trie-nodes")
    discard(laid)
    told = found.filter("place IS NOT NULL").select("place", "total", "front").orderBy("place").collect()
    upto = np.concatenate([[0], np.cumsum([r["total"] for r in told])])
    fronts = [np.array(r["front"], np.int64) for r in told]

    def finished(batches):
        for batch in batches:
            block, stop, step = (batch.column(c).to_numpy() for c in ("block", "stop", "step"))
            saved = batch.column("own_saved").to_numpy().copy()
            on = np.flatnonzero(step >= 0)
            saved[on] += upto[stop[on]] - upto[block[on] + 1] + np.array([fronts[s][k] if s < len(fronts) else 0 for s, k in zip(stop[on], step[on])], np.int64)
            ends = pa.array([d.hex() for d in batch.column("ends").to_pylist()], pa.string())
            depth = batch.column("depth").to_numpy()
            parent = pa.array(batch.column("parent_conv_id").to_numpy(), mask=depth == 0)
            keep = ["conv_id", "depth", "n_convs", "n_children", "n_leaves"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep[:2]], parent, *[batch.column(c) for c in keep[2:]], pa.array(saved), ends], [c.split()[0] for c in TRIE.split(", ")])

    return found.filter("place IS NULL").drop("place", "total", "front").mapInArrow(finished, TRIE)


TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
