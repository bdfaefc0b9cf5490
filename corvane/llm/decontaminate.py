"""Benchmark decontamination by suffix arrays of the training texts.

The benchmark is a stated query set. It is read in blocks of bounded size, and each block is sent to the tasks, which
run over all documents. A task takes a shard (a slice of whole documents), sorts the suffixes of its words into a
suffix array and looks every test suffix up by binary search: the range found holds all its places. Suffixes that
don't open with a short run of words of the block can't be in any such range and stay out of the array, which changes
no result. Neighbouring places on one diagonal of a document and an item join to longest verbatim matches.

Words: A-Z lower-cased, then runs of digits, a-z and non-ASCII characters. A test suffix is `n` consecutive words of an
item; an item of fewer words is one shorter test. Null and empty texts have no words and no matches; items without words
take no part. The words of an item without an id are hit as any other's, but it isn't among the items named. Equal rows
give equal results; a test that several items share is told under the smallest. A very long text is a shard of its own.
Other columns are not read, whatever their names (`decontaminated` keeps them). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corvane.llm.common import schema_of, slices, text_bytes
from corvane.llm.words import alnum_words, word_hashes

WINDOW = 13
#: Words of benchmark text in a block that is sent to the tasks.
BLOCK_WORDS = 1 << 20
FOUND = "array<struct<item:string,first:bigint,item_first:bigint,n_words:bigint>>"
MATCH = pa.struct([("item", pa.string()), ("first", pa.int64()), ("item_first", pa.int64()), ("n_words", pa.int64())])


class Block:
    """Test suffixes of some items, as sorted keys."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], n: int):
        # Items without an id come first.
        self.names = sorted({k for k, _ in items}, key=lambda k: (k is not None, k or ""))
        number = {k: i for i, k in enumerate(self.names)}
        self.n = n
        self.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
        tests: dict[bytes, list[tuple[int, int]]] = {}
        for k, w in items:
            rank = (np.searchsorted(self.vocabulary, w) + 1).astype(">u4")
            for i in range(max(1, len(w) - n + 1)):
                tests.setdefault(rank[i : i + n].tobytes(), []).append((number[k], i))
        self.keys = sorted(tests)
        self.length = np.array([len(k) // 4 for k in self.keys])
        self.low = np.array([k.ljust(4 * n, b"\0") for k in self.keys], f"S{4 * n}")
        self.high = np.array([k.ljust(4 * n, b"\xff") for k in self.keys], f"S{4 * n}")
        self.place = [min(tests[k]) for k in self.keys]
        self.owners = [np.unique([i for i, _ in tests[k]]) for k in self.keys]
        self.open = min(4, int(self.length.min()))

    def suffix_array(self, ranks: np.ndarray, end: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin at the positions `at`, in lexicographic order to the depth of n words, and their keys."""
        key = np.zeros((len(at), self.n), ">u4")
        for j in range(self.n):
            inside = at + j < end
            key[inside, j] = ranks[at[inside] + j]
        key = np.frombuffer(key.tobytes(), f"S{4 * self.n}")
        order = np.argsort(key, kind="stable")
        return at[order], key[order]

    def find(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places (word, test) at which a test's words stand. first: the number of each text's first word."""
        known = self.seen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]
        start = known.copy()
        for j in range(1, self.open):
            start[: len(known) - j] &= known[j:]
            start[max(0, len(known) - j) :] = False
        at = np.flatnonzero(start)
        if not len(at):
            return at, at
        near = np.unique(np.minimum((at[:, None] + np.arange(self.n)).ravel(), len(hashes) - 1))
        ranks = np.zeros(len(hashes), np.uint32)
        spot = np.minimum(np.searchsorted(self.vocabulary, hashes[near]), len(self.vocabulary) - 1)
        ranks[near] = np.where(self.vocabulary[spot] == hashes[near], spot + 1, 0)
        at = at[ranks[at] > 0]
        suffixes, keys = self.suffix_array(ranks, first[np.searchsorted(first, at, side="right")], at)
        lo, hi = np.searchsorted(keys, self.low, side="left"), np.searchsorted(keys, self.high, side="right")
        size = np.maximum(hi - lo, 0)
        test = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(test)) - np.repeat(np.cumsum(size) - size, size)
        return suffixes[lo[test] + inner], test

    def matches(self, column: pa.Array) -> tuple[np.ndarray, dict[int, list[dict]], dict[int, list[str]]]:
        """Words of each text; by row its longest matches, each under the first item with those words; by row all items found."""
        buf, at = text_bytes(column)
        low, starts, ends, first = alnum_words(buf, at)
        where, test = self.find(word_hashes(low, starts, ends), first)
        doc = np.searchsorted(first, where, side="right") - 1
        found: dict[int, list[dict]] = {}
        items: dict[int, list[str]] = {}
        if len(where):
            place = np.array([self.place[t] for t in test])
            diagonal = where - place[:, 1]
            order = np.lexsort((where, diagonal, place[:, 0], doc))
            d, p, t = doc[order], where[order], test[order]
            fresh = (np.diff(d, prepend=-1) != 0) | (np.diff(place[order, 0], prepend=-1) != 0) | (np.diff(diagonal[order], prepend=-(1 << 60)) != 0) | (np.diff(p, prepend=-9) > 1)
            run = np.flatnonzero(fresh)
            last = np.append(run[1:], len(p)) - 1
            for a, b in zip(run, last):
                item, i = self.place[t[a]]
                found.setdefault(int(d[a]), []).append({"item": self.names[item], "first": int(p[a] - first[d[a]]), "item_first": i, "n_words": int(p[b] + self.length[t[b]] - p[a])})
            pairs = np.unique(np.stack([doc, test]), axis=1)
            for x in np.unique(pairs[0]):
                own = np.unique(np.concatenate([self.owners[t] for t in pairs[1][pairs[0] == x]]))
                items[int(x)] = [self.names[i] for i in own if self.names[i] is not None]
        return np.diff(first), found, items


def blocks(benchmark: DataFrame, n: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of about block_words words; rows reach the driver a partition at a time."""
    batch: list[tuple[str | None, np.ndarray]] = []
    size = 0
    for row in benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), "text").toLocalIterator():
        buf, at = text_bytes(pa.array([row["text"] or ""]))
        low, starts, ends, _ = alnum_words(buf, at)
        if not len(starts):
            continue
        if size and size + len(starts) > block_words:
            yield Block(batch, n)
            batch, size = [], 0
        batch.append((row["item_id"], word_hashes(low, starts, ends)))
        size += len(starts)
    if batch:
        yield Block(batch, n)


def covered(found: list[dict]) -> int:
    """Words under any of the matches."""
    total, upto = 0, -1
    for a, b in sorted((m["first"], m["first"] + m["n_words"]) for m in found):
        total += max(0, b - max(a, upto))
        upto = max(upto, b)
    return total


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], n: int = WINDOW) -> DataFrame:
    """`keep` columns of docs, then __n_words, __found (longest matches) and __items of every document; a map without shuffle."""
    spark = docs.sparkSession
    out = docs.select(*keep, docs["text"].alias("__text")).selectExpr("*", "0L AS __n_words", f"CAST(array() AS {FOUND}) AS __found", "CAST(array() AS array<string>) AS __items")
    empty = Block([("", np.zeros(1, np.uint64))], n)
    for block in blocks(benchmark, n) if benchmark is not None else ():
        out = _with_block(out, spark.sparkContext.broadcast(block))
        empty = None
    # Without any test, words are counted all the same.
    out = _with_block(out, spark.sparkContext.broadcast(empty)) if empty else out
    return out.drop("__text")


def _with_block(df: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                n_words, found, items = block.matches(part.column("__text"))
                k = part.schema.names.index("__n_words")
                columns = part.columns
                columns[k] = pa.array(n_words.astype(np.int64))
                if found or part.column("__found").null_count:
                    columns[k + 1] = pa.array([x + found.get(i, []) for i, x in enumerate(columns[k + 1].to_pylist())], pa.list_(MATCH))
                    columns[k + 2] = pa.array([x + items.get(i, []) for i, x in enumerate(columns[k + 2].to_pylist())], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, part.schema.names)

    return df.mapInArrow(run, df.schema)


def verdicts(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the matches themselves, of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words = batch.column("__n_words").to_numpy()
            found, items = batch.column("__found").to_pylist(), batch.column("__items").to_pylist()
            n_hit = np.array([covered(x) if x else 0 for x in found], np.int64)
            own = [sorted(set(x)) for x in items]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_words": n_words,
                    "n_hit": n_hit,
                    "n_items": np.array([len(x) for x in own], np.int64),
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in own],
                    "contaminated": (n_hit > 0) & (20 * n_hit >= n_words),
                    "matches": batch.column("__found"),
                }
            )

    result = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, matches {FOUND}"
    return scanned(docs, benchmark, ["doc_id"], n).mapInArrow(run, result)


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """docs, all columns, without the contaminated documents."""
    names = [f"__c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    held = inner.withColumn("text", inner[names[docs.columns.index("text")]])
    full = scanned(held, benchmark, names, n)
    schema = schema_of(", ".join(f"{x} {f.dataType.simpleString()}" for x, f in zip(names, docs.schema.fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = np.array([covered(x) if x else 0 for x in batch.column("__found").to_pylist()], np.int64)
            clean = ~((n_hit > 0) & (20 * n_hit >= batch.column("__n_words").to_numpy()))
            yield batch.select(names).filter(pa.array(clean))

    return full.mapInArrow(run, schema).toDF(*docs.columns)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Verdict on every document against the whole benchmark."""
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("matches")
