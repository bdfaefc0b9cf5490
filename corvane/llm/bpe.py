"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words, and decoding by joining pieces.

The words of a slice of texts are told apart first; only distinct ones are folded, all at the same time: in each step
every word merges the leftmost of its adjacent pairs whose joined bytes have the lowest rank, until no pair has one.
The rank map is a literal that goes to the tasks with the code; the file it comes from is a parameter.
Decoding concatenates the binary pieces of the ids.

Null and empty texts have no ids. Equal rows give equal results; of equal ranks the leftmost pair goes first. A very
long text is a slice of its own, and a very long word is folded with a heap. Other columns are not read, whatever their
names. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import slices, text_bytes
from corvane.llm.pieces import PATTERN, Encoder, expect

NONE = np.int64(1 << 40)
#: Words of more bytes are folded one by one with a heap, which takes n log n steps.
LONG = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        #: All ways to join two tokens to a third: the pair as one number, and the third.
        joins = {(ranks[t[:i]] << 32) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pairs = np.array(sorted(joins), np.int64)
        self.joined = np.array([joins[k] for k in self.pairs.tolist()], np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        tokens = sorted(ranks, key=ranks.get)
        ids = np.array([ranks[t] for t in tokens])
        self.token_size = np.zeros(ids.max() + 1, np.int64)
        self.token_size[ids] = [len(t) for t in tokens]
        self.token_at = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = [str(i) for i in range(int(ids.max()) + 1)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        spot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[spot] == key, self.joined[spot], NONE)

    def fold(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. A word that is itself a token is that token."""
        out: list = [None] * len(words)
        rest = []
        for i, w in enumerate(words):
            if w in self.ranks:
                out[i] = [self.ranks[w]]
            elif len(w) > LONG:
                out[i] = self.fold_long(w)
            else:
                rest.append(i)
        if not rest:
            return out
        size = np.array([len(words[i]) for i in rest])
        ids = self.single[np.frombuffer(b"".join(words[i] for i in rest), np.uint8)]
        who = np.array(rest)
        rank = np.append(self.rank_of(ids[:-1], ids[1:]), NONE)
        rank[np.cumsum(size) - 1] = NONE
        while len(who):
            start = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[who[k]] = ids[start[k] : start[k] + size[k]].tolist()
                stay = np.repeat(~done, size)
                ids, rank, who, size, low = ids[stay], rank[stay], who[~done], size[~done], low[~done]
                start = np.cumsum(size) - size
                if not len(who):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            owner = np.searchsorted(start, at, side="right") - 1
            at = at[np.diff(owner, prepend=-1) != 0]
            # Merge at `at`, drop what stood right of it, and rank the pairs on both sides anew.
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            rank[np.flatnonzero(~keep) - 1] = rank[~keep]
            ids, rank, size = ids[keep], rank[keep], size - 1
            start = np.cumsum(size) - size
            last = start + size - 1
            right = at[at < last]
            rank[right] = self.rank_of(ids[right], ids[right + 1])
            rank[last] = NONE
            left = at[at > start] - 1
            rank[left] = self.rank_of(ids[left], ids[left + 1])
        return out

    def fold_long(self, word: bytes) -> list[int]:
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        table = dict(zip(self.pairs.tolist(), self.joined.tolist())) if not hasattr(self, "_table") else self._table
        self._table = table
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get((ids[i] << 32) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := table.get((ids[x] << 32) | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.token_size[ids]
        upto = np.cumsum(size)
        return self.token_bytes[np.repeat(self.token_at[ids] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)].tobytes()


_MADE: dict[int, tuple[Merges, Encoder]] = {}


def _made(shared) -> tuple[Merges, Encoder]:
    """The rank map's tables and the words met so far, kept from task to task of a Python worker."""
    if shared.value is not None and id(shared.value) not in _MADE:
        merges = Merges(shared.value)
        _MADE.clear()
        _MADE[id(shared.value)] = merges, Encoder(merges.fold)
    return _MADE[id(shared.value)]


def encoded(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """`keep` columns and ids (array<int>) of every text. shared: a broadcast of load_ranks()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _made(shared)[1]
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, at = encoder.ids(*text_bytes(part.column("__text")))
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, column], [*keep, "ids"])

    rows = docs.select(*keep, docs["text"].alias("__text"))
    return rows.mapInArrow(run, rows.drop("__text").withColumn("ids", F.array().cast("array<int>")).schema)


def decoded(rows: DataFrame, shared, keep: list[str]) -> DataFrame:
    """`keep` columns and the bytes (decoded, binary) that the ids of each row stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _made(shared)[0]
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                texts = [merges.decode(x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.zeros(0, np.int64)) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, pa.array(texts, pa.binary())], [*keep, "decoded"])

    return rows.select(*keep, "ids").mapInArrow(run, rows.select(*keep).selectExpr("*", "X'' AS decoded").schema)


def round_trip(docs: DataFrame, path: str, keep: list[str], pattern: str = PATTERN) -> DataFrame:
    """`keep` columns, n_tokens, ids_sha256 and decoded_sha256 of every text: encoded and then decoded from the ids, in one pass.

    pattern: what splits texts before the merges; only pieces.PATTERN is provided for.
    """
    expect(pattern)
    # One vocabulary goes to the tasks: its size is the file's, whatever the number of documents.
    shared = docs.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, encoder = _made(shared)
        for batch in batches:
            for part in slices(batch, "__text"):
                ids, at = encoder.ids(*text_bytes(part.column("__text")))
                back = merges.decode(ids)
                upto = np.append(0, np.cumsum(merges.token_size[ids]))[at]
                text = [merges.decimal[i] for i in ids.tolist()]
                at, upto = at.tolist(), upto.tolist()
                own = range(part.num_rows)
                sums = [hashlib.sha256(",".join(text[at[i] : at[i + 1]]).encode()).hexdigest() for i in own]
                again = [hashlib.sha256(back[upto[i] : upto[i + 1]]).hexdigest() for i in own]
                columns = [pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.string()), pa.array(again, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.select(keep).columns, *columns], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(*keep, docs["text"].alias("__text"))
    return rows.mapInArrow(run, rows.drop("__text").selectExpr("*", "0L AS n_tokens", "'' AS ids_sha256", "'' AS decoded_sha256").schema)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual rank file, and what they decode to."""
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), ["doc_id"], public_tokenizers.PATTERN)
