"""Exact search for windows of `k` symbols that occur earlier in a table of sequences, through sampled suffixes.

A row for every window would be many times the input. Instead each window is represented by its anchor: the q-gram in
it with the smallest hash (the leftmost of ties). Equal windows have equal anchors at equal places, and neighbouring
windows mostly share theirs, so a sequence falls into runs of windows with one anchor, a few hundredths of its length.

1. Runs are dealt into buckets by their anchor's q-gram. Within a bucket they are ordered by q-gram and then by the
   identifier of all symbols the run covers. A run whose identifier occurs earlier is repeated as a whole. A q-gram
   with one identifier only is settled. All other runs stay open.
2. Only open runs are refined: each of their windows gets an identifier of its own, and these are dealt and ordered
   in the same way. Windows whose identifier occurs earlier are repeated.

Tasks send packets: columns of many runs for one bucket, packed. A packet holds one run of each q-gram and identifier
(later ones of the same task are known to be repeated), and a q-gram with more than HOT identifiers in one packet is
sent as a mark with its runs left open. What a task decides so goes past the buckets, dealt by packet. So no group,
however large, meets in one task: a bucket gets at most HOT runs of a q-gram from each packet of about PACKET runs.
Texts travel to their entries packed, one by one.

Identifiers come from one of two namers. `Polynomial` hashes a q-gram with one multiplier and a run with another;
of single windows both hashes are of the whole window. `Pointers` names by doubling: a q-gram's bucket identifier is a hash
of its symbols, that of twice as many symbols a hash of two identifiers, the second at a later offset. As identifiers
come from contents alone, they are had where the text is, without a join. Of a q-gram's identifier the bucket's number
and 32 more bits travel, of a run's all 64.

Ids order sequences, null first. Different texts under one id (null ids, say) are told apart by `sub`, a digest of the
text that is 0 wherever an id has one text only: it takes no room there. Equal rows are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import nat, parts, slices, staged, text_bytes
from corvane.llm.words import BYTE_VALUES, OTHER, Rolling, mix

#: Window starts handled at once in one long sequence; the place of a q-gram in them fits the mask's bits.
STEP, MASK = 1 << 18, np.uint64((1 << 22) - 1)
PACKET, HOT = 1 << 18, 64
#: Bytes of text whose runs may meet in one bucket.
BUCKET_BYTES = 128 << 20
#: What is known of a run: nothing (or, once settled, that others repeat it), that it occurs earlier, that its windows must
#: be looked at, that its q-gram is left open, that its task has seen it again in later documents, that it is the first of
#: those although left open.
RUN, DUP, OPEN, MARK, SEEN, FIRST = range(6)
ENTRY = np.dtype([("lo", "<u4"), ("n", "<u2")])
NAMED = np.dtype([("lo", "<u4"), ("n", "<u2"), ("name", "<u8"), ("gram", "<u4")])
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    size = len(v) - w + 1
    m, span = v, 1
    while 2 * span <= w:
        m = np.minimum(m[: len(m) - span], m[span:])
        span *= 2
    return np.minimum(m[:size], m[w - span : w - span + size])


def valued(symbols: np.ndarray) -> np.ndarray:
    """Symbols as 64-bit values: words are hashes already, bytes get random values."""
    return BYTE_VALUES[symbols] if symbols.dtype == np.uint8 else symbols


class Polynomial:
    """Two independent hashes of stretches of one sequence of values."""

    def __init__(self, values: np.ndarray, q: int):
        self.values, self.q = values, q
        self.content = Rolling(values, OTHER)

    def grams(self) -> np.ndarray:
        return Rolling(self.values).grams(self.q)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.content.span(start, end)

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return Rolling(self.values).span(start, end)


class Pointers:
    """Bucket identifiers of stretches of one sequence of values, of q values at least, by doubling."""

    def __init__(self, values: np.ndarray, q: int):
        self.q = q
        self.levels = [Rolling(values).grams(q)]

    def grams(self) -> np.ndarray:
        return self.levels[0]

    def level(self, j: int) -> np.ndarray:
        """Identifiers of all stretches of q << j values."""
        while len(self.levels) <= j:
            last, h = self.levels[-1], self.q << (len(self.levels) - 1)
            self.levels.append(refined(last[: max(0, len(last) - h)], last[h:]))
        return self.levels[j]

    def _depths(self, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The stretches by the level at which two identifiers cover them."""
        depth = np.ceil(np.log2(np.maximum((end - start) / (2 * self.q), 1))).astype(np.int64)
        for j in np.unique(depth).tolist():
            yield j, np.flatnonzero(depth == j)

    def first(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The identifier that a stretch begins with."""
        out = np.empty(len(start), np.uint64)
        for j, own in self._depths(start, end):
            out[own] = self.level(j)[start[own]]
        return out

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The first identifier refined by that of the later offset which reaches the stretch's end."""
        out = np.empty(len(start), np.uint64)
        for j, own in self._depths(start, end):
            level = self.level(j)
            out[own] = refined(level[start[own]], level[end[own] - (self.q << j)])
        return out


def refined(bucket: np.ndarray, later: np.ndarray) -> np.ndarray:
    return mix(bucket * np.uint64(OTHER) + later)


Namer = type[Polynomial] | type[Pointers]


def runs(symbols: np.ndarray, at: np.ndarray, k: int, q: int, namer: Namer) -> tuple[np.ndarray, ...]:
    """(sequence, first window's place in it, windows, q-gram, identifier) of each run."""
    out = []
    for s in range(0, len(symbols), STEP):
        e = min(len(symbols), s + STEP + k - 1)
        if e - s < k:
            continue
        names = namer(valued(symbols[s:e]), q)
        g = names.grams()
        m = sliding_min((g & ~MASK) | np.arange(len(g), dtype=np.uint64), k - q + 1)
        owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(np.clip(at, s, e)))
        doc = owner[: len(m)]
        ok = np.flatnonzero(doc == owner[k - 1 : k - 1 + len(m)])
        if not len(ok):
            continue
        a, doc = (m[ok] & MASK).astype(np.int64), doc[ok]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(first, len(ok)))
        lo = ok[first]
        doc = doc[first]
        out.append((doc, lo + s - at[doc], n, g[a[first]], names.span(lo, lo + n - 1 + k)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int32, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out))


class Packets:
    """Collects runs and gives them out as packets by bucket."""

    def __init__(self, buckets: int, other: bool, exact: bool, named: bool):
        self.buckets, self.other, self.exact, self.named = buckets, other, exact, named
        # Where this task's packets of decided runs begin to be dealt.
        self.turn = TaskContext.get().partitionId() if TaskContext.get() else 0
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = 0

    def add(self, doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, n: np.ndarray, g: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(doc):
            self.held.append((doc, sub, lo, n, g, c))
            self.n += len(doc)
        if self.n >= PACKET:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        doc, sub, lo, n, g, c = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.n = [], 0
        kind = np.full(len(doc), RUN, np.uint8)
        order = ordered(g, c, doc, sub, lo)
        doc, sub, lo, n, g, c = doc[order], sub[order], lo[order], n[order], g[order], c[order]
        dup, new_g, new_c = repeated(g, c, doc, sub, lo, self.other)
        content = np.cumsum(new_c) - 1
        kind[(np.bincount(content, weights=dup) > 0)[content]] = SEEN
        kind[dup] = DUP
        # Single windows are dealt by all they hold: many may begin alike.
        bucket = ((mix(g + c) if self.exact else g) % np.uint64(self.buckets)).astype(np.int64)
        if not self.exact:
            group = np.cumsum(new_g) - 1
            hot = np.bincount(group, weights=new_c) > HOT
            marks = np.flatnonzero(new_g)[hot]
            again = np.flatnonzero(hot[group] & (kind == SEEN) & self.named)
            kind[hot[group] & (kind != DUP)] = OPEN
            if len(marks):
                pad = lambda x: np.concatenate([x, x[marks], x[again]])
                kind = np.concatenate([kind, np.full(len(marks), MARK, np.uint8), np.full(len(again), FIRST, np.uint8)])
                doc, sub, lo, n, g, c, bucket = map(pad, (doc, sub, lo, n, g, c, bucket))
        g = (g >> np.uint64(32)).astype(np.uint32)
        told = (kind == DUP) | (kind == OPEN) | (kind == FIRST)
        g[(kind == OPEN) | ((kind == DUP) & (not self.named))] = 0
        bucket[told] = self.buckets + self.turn % self.buckets
        self.turn += 1
        c[(kind == OPEN) | (kind == MARK) | ((kind == DUP) & (not self.named))] = 0
        order = np.lexsort((sub, doc, kind, bucket))
        bucket = bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        columns = [kind, g, c, doc, sub, lo.astype(np.uint32), n.astype(np.uint16)]
        columns = [x[order] for x in columns]
        ids, payload = [], []
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
            raw = np.int64(b - a).tobytes() + b"".join(np.diff(x[a:b], prepend=0).tobytes() if x.dtype == np.int64 else x[a:b].tobytes() for x in columns)
            ids.append(bucket[a])
            payload.append(np.int64(len(raw)).tobytes() + pa.compress(raw, "zstd", asbytes=True))
        yield pa.record_batch({"bucket": pa.array(ids, pa.int32()), "payload": pa.array(payload, pa.binary())})


def unpacked(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """kind, g, c, doc, sub, lo, n of all runs in some packets."""
    out = []
    for p in payloads:
        raw = pa.decompress(p[8:], int.from_bytes(p[:8], "little"), "zstd", asbytes=True)
        m, at, own = int.from_bytes(raw[:8], "little"), 8, []
        for t in (np.uint8, np.uint32, np.uint64, np.int64, np.int64, np.uint32, np.uint16):
            own.append(np.frombuffer(raw, t, m, at))
            at += m * np.dtype(t).itemsize
        kind, g, c, doc, sub, lo, n = own
        out.append((kind, g, c, np.cumsum(doc), np.cumsum(sub), lo, n))
    return tuple(np.concatenate(x) for x in zip(*out))


def ordered(g: np.ndarray, c: np.ndarray, doc: np.ndarray, sub: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.lexsort((lo, sub, doc, c, g))


def repeated(g: np.ndarray, c: np.ndarray, doc: np.ndarray, sub: np.ndarray, lo: np.ndarray, other: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of runs in order: those that occur earlier (other: in a document with a smaller id), and where q-grams and identifiers begin."""
    new_g = np.concatenate([[True], g[1:] != g[:-1]])
    new_c = new_g | np.concatenate([[True], c[1:] != c[:-1]])
    first = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
    dup = doc > doc[first]
    if not other:
        dup |= (sub != sub[first]) | (lo > lo[first])
    return dup, new_g, new_c


def settle(payloads: list[bytes], other: bool, exact: bool, named: bool) -> pa.RecordBatch:
    """One bucket's runs decided: by document, those repeated and those open; if named, also those that others repeat, and all with their content's name."""
    kind, g, c, doc, sub, lo, n = unpacked(payloads)
    live = (kind == RUN) | (kind == SEEN)
    order = ordered(g[live], c[live], doc[live], sub[live], lo[live])
    lg, lc, ld, ls, ll, ln = (x[live][order] for x in (g, c, doc, sub, lo, n))
    state = np.full(len(lg), MARK, np.uint8)
    source = np.zeros(0, np.int64)
    if len(lg):
        dup, new_g, new_c = repeated(lg, lc, ld, ls, ll, other)
        state[dup] = DUP
        if not exact:
            group = np.cumsum(new_g) - 1
            start = np.flatnonzero(new_g)
            mixed = np.bincount(group, weights=new_c) > 1
            if other:
                mixed &= np.minimum.reduceat(ld, start) != np.maximum.reduceat(ld, start)
            mixed |= np.isin(lg[start], g[kind == MARK])
            state[mixed[group] & (state == MARK)] = OPEN
        if named:
            content = np.cumsum(new_c) - 1
            again = np.bincount(content, weights=dup | (kind[live][order] == SEEN)) > 0
            source = np.flatnonzero(again[content] & ~dup)
    told = (kind == DUP) | (kind == OPEN) | (kind == FIRST)
    # A run that others repeat may be open, too: its windows can occur earlier in other runs.
    pile = lambda x, own: np.concatenate([own, own[source], x[told]])
    doc, sub, lo, n, c, g = (pile(x, own) for x, own in ((doc, ld), (sub, ls), (lo, ll), (n, ln), (c, lc), (g, lg)))
    state = np.concatenate([state, np.full(len(source), RUN, np.uint8), np.where(kind == FIRST, RUN, kind)[told]])
    keep = state != MARK
    state, doc, sub, lo, n, c, g = (x[keep] for x in (state, doc, sub, lo, n, c, g))
    order = np.lexsort((lo, state, sub, doc))
    state, doc, sub, lo, n, c, g = (x[order] for x in (state, doc, sub, lo, n, c, g))
    entry = np.zeros(len(doc), NAMED if named else ENTRY)
    entry["lo"], entry["n"] = lo, n
    if named:
        entry["name"], entry["gram"] = np.where(state == OPEN, 0, c), np.where(state == OPEN, 0, g)
    edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (sub[1:] != sub[:-1]) | (state[1:] != state[:-1])])) if len(doc) else np.zeros(0, np.int64)
    offsets = np.append(edges, len(doc)).astype(np.int32) * entry.itemsize
    blob = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(entry.tobytes())])
    return pa.record_batch({"id": pa.array(doc[edges]), "sub": pa.array(sub[edges]), "state": pa.array(state[edges].astype(np.int32)), "entries": blob})


def settled(packets: DataFrame, other: bool, exact: bool, named: bool) -> DataFrame:
    def decide(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([settle(table.column("payload").to_pylist(), other, exact, named)])

    return packets.groupBy("bucket").applyInArrow(decide, "id long, sub long, state int, entries binary")


def _buckets(df: DataFrame, size: int) -> int:
    """A few to each shuffle partition, so that partitions even out, and more if texts of `size` bytes need them."""
    return max(4 * parts(df.sparkSession), -(-size // BUCKET_BYTES))


def _packed(docs: DataFrame, symbols: Symbols, k: int, q: int, other: bool, buckets: int, named: bool, namer: Namer = Polynomial) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = Packets(buckets, other, False, named)
        for batch in batches:
            for part in slices(batch, "__text"):
                sym, at = symbols(part.column("__text"))
                doc, lo, n, g, c = runs(sym, at, k, q, namer)
                yield from packets.add(part.column("__id").to_numpy()[doc], part.column("__sub").to_numpy()[doc], lo, n, g, c)
        yield from packets.flush()

    return docs.mapInArrow(run, "bucket int, payload binary")


def entries(blobs: list[bytes] | None, named: bool = False) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or ()), NAMED if named else ENTRY)


def spread(found: np.ndarray) -> np.ndarray:
    """The places of all windows in some entries."""
    n = found["n"].astype(np.int64)
    return np.repeat(found["lo"].astype(np.int64) - np.cumsum(n) + n, n) + np.arange(n.sum())


def _refined(docs: DataFrame, symbols: Symbols, k: int, q: int, other: bool, buckets: int, named: bool, namer: Namer) -> DataFrame:
    """Packets of the single windows in open runs. docs: __id, __sub, __text (packed), __open (their entries)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packets = Packets(buckets, other, True, named)
        for batch in batches:
            for part in slices(unpacked_texts(batch, "__text"), "__text"):
                sym, at = symbols(part.column("__text"))
                ids, subs, opened = part.column("__id").to_numpy(), part.column("__sub").to_numpy(), part.column("__open").to_pylist()
                places = [spread(entries(x, named)) for x in opened]
                doc = np.repeat(np.arange(len(places)), [len(x) for x in places])
                place = np.concatenate(places)
                # In stretches, so that powers stay small for long texts.
                at_all = at[doc] + place
                order = np.argsort(at_all, kind="stable")
                at_all, doc, place = at_all[order], doc[order], place[order]
                fits = at_all + k <= at[doc + 1]
                at_all, doc, place = at_all[fits], doc[fits], place[fits]
                i = 0
                while i < len(at_all):
                    j = int(np.searchsorted(at_all, at_all[i] + STEP))
                    names = namer(valued(sym[at_all[i] : at_all[j - 1] + k]), q)
                    start = at_all[i:j] - at_all[i]
                    yield from packets.add(ids[doc[i:j]], subs[doc[i:j]], place[i:j], np.ones(j - i, np.int64), names.first(start, start + k), names.span(start, start + k))
                    i = j
        yield from packets.flush()

    return docs.mapInArrow(run, "bucket int, payload binary")


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs (doc_id, text, any more) with __id and __sub, the key of a row's text (see the head of this module); and bytes of text."""
    key, digest = nat("doc_id").alias("__id"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()["size"]
    each = docs.select(key, digest.alias("h")).groupBy("__id").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    # Written, so that the planner knows its size: mostly it is empty, and texts need no shuffle.
    several = staged(each.filter("lo <> hi").select("__id", F.lit(True).alias("__several")), "repeats-ids")
    rows = docs.withColumn("__id", nat("doc_id")).join(several, "__id", "left")
    return rows.withColumn("__sub", F.when(F.col("__several"), digest).otherwise(F.lit(0).cast("long"))).drop("__several"), size


def packed_texts(rows: DataFrame, text: str) -> DataFrame:
    """rows with each text packed: what is joined with entries crosses a shuffle at less than half its size."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text else f.dataType) for f in rows.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = (None if x is None else x.encode() for x in batch.column(text).to_pylist())
            packed = [None if x is None else len(x).to_bytes(8, "little") + pa.compress(x, "zstd", asbytes=True) for x in raw]
            i = batch.schema.get_field_index(text)
            yield batch.set_column(i, text, pa.array(packed, pa.binary()))

    return rows.mapInArrow(run, schema)


def unpacked_text(packed: bytes | None) -> bytes | None:
    return None if packed is None else pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def unpacked_texts(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    i = batch.schema.get_field_index(text)
    return batch.set_column(i, text, pa.array(map(unpacked_text, batch.column(text).to_pylist()), pa.binary()))


def repeats(docs: DataFrame, size: int, symbols: Symbols, k: int, q: int, other: bool, named: bool = False, namer: Namer = Polynomial) -> DataFrame:
    """Of keyed() rows with `size` bytes of text: __id, __sub, level (0: runs, 1: windows), state and entries (first window, windows).

    State DUP: windows that occur earlier; with `other`, in a document with a smaller id, else also earlier in the same one
    or under its id. If named, also state RUN: windows that others repeat, which are themselves not known to occur earlier
    at their level; entries then hold a name of 96 bits (name, gram), equal for equal contents alone. Every content that
    is DUP somewhere is RUN in its first document.
    """
    rows = docs.select("__id", "__sub", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    buckets = _buckets(rows, size)
    coarse = staged(settled(_packed(rows, symbols, k, q, other, buckets, named, namer), other, False, named), "repeats-runs")
    found = lambda df, level: df.select(F.col("id").alias("__id"), F.col("sub").alias("__sub"), F.lit(level).alias("level"), "state", "entries")
    opened = found(coarse.filter(F.col("state") == OPEN), 0).groupBy("__id", "__sub").agg(F.collect_list("entries").alias("__open"))
    fine = settled(_refined(packed_texts(rows, "__text").join(opened, ["__id", "__sub"]), symbols, k, q, other, buckets, named, namer), other, True, named)
    return found(coarse.filter(F.col("state") != OPEN), 0).unionByName(found(fine, 1))


def gathered(found: DataFrame) -> DataFrame:
    """__dup by __id and __sub: the entries of all windows that occur earlier."""
    return found.groupBy("__id", "__sub").agg(F.collect_list("entries").alias("__dup"))


def covered(lo: np.ndarray, n: np.ndarray, k: int, size: int) -> np.ndarray:
    """Whether each of `size` symbols lies in one of the windows lo, ..., lo + n - 1."""
    step = np.zeros(size + 1, np.int32)
    lo = lo.astype(np.int64)
    ok = lo + n + k - 1 <= size
    np.add.at(step, lo[ok], 1)
    np.subtract.at(step, (lo + n + k - 1)[ok], 1)
    return np.cumsum(step[:-1]) > 0


def byte_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(column)


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from corvane.llm.words import BLANK, word_hashes, word_spans

    buf, at = text_bytes(column)
    starts, ends, first = word_spans(buf, at, ~BLANK)
    return word_hashes(buf, starts, ends), first
