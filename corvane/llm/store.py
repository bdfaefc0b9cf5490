"""Token ids in a content-addressed store.

A rolling hash over the last WINDOW ids cuts each document's id stream into chunks: equal stretches are cut alike
wherever they stand. A chunk is stored once under its digest. A document's recipe lists its chunks, and manifests hold
the recipes in ascending doc_id with the start of each document and the Merkle root of its chunks' digests. Roots lie
over each LEAF documents, over each range of these, and over all.

Layout under the store's folder, all Parquet: data/kind=chunk (digest, n, payload: ids as little-endian unsigned 16-bit;
a vocabulary of more than 65,536 ids is refused), data/kind=recipe, manifest (ordered by doc_id) and roots. All are
written by Spark into the shared folder, so a lost executor's part is written anew.

Reading verifies: the manifest against its roots, every payload against its digest, every recipe against its Merkle
root, and a chunk that is missing or wrong makes the document fail. A document's crc32 is combined from its chunks', so
checking all documents moves no payload; `restored` joins the payloads for those asked for.

The strings of special tokens in a text become these tokens' ids, as the tokenizers library has it by default.
Null and empty texts hold the end id alone. Of rows with one doc_id each is a document, in the order of their digests;
null comes first. A very long text is encoded whole, and its recipe lists any number of chunks. Other columns are not
read, whatever their names. An empty table makes an empty store.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import bucket_of, joined_by, nat, new_path, parts, range_bounds, slices, staged, text_bytes
from corvane.llm.pieces import Encoder
from corvane.llm.words import mix

END = 0
#: Ids that the rolling hash looks at; chunks end where it has BITS zero bits, and hold LEAST to MOST ids.
WINDOW, BITS, LEAST, MOST = 16, 9, 64, 4096
DIGEST = 16
#: Documents under one leaf of the manifest's roots, and ids that two bytes can tell apart.
LEAF, IDS = 4096, 1 << 16
#: Bytes of text encoded at a time, and distinct pieces that a task remembers: the library takes some 10 microseconds for each new one.
SLICE, REMEMBERED = 1 << 20, 1_500_000
_ENCODERS: dict[str, TextEncoder] = {}


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=DIGEST).digest()


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over some digests; an odd one moves up as it is."""
    level = digests or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """For each stream at[i]:at[i+1] of ids, where its chunks end."""
    values = mix(ids.astype(np.uint64) + np.uint64(1))
    # A sum over the window: depends on its ids alone, and on their order through the multiplier of each place.
    weight = mix(np.arange(1, WINDOW + 1, dtype=np.uint64))
    rolled = np.zeros(len(ids), np.uint64)
    for k in range(WINDOW):
        rolled[k:] += values[: len(ids) - k] * weight[k]
    marks = np.flatnonzero(mix(rolled) >> np.uint64(64 - BITS) == 0) + 1
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own, last = [], a
        for m in marks[np.searchsorted(marks, a + LEAST) : np.searchsorted(marks, b)].tolist():
            while m - last > MOST:
                last += MOST
                own.append(last)
            if m - last >= LEAST:
                own.append(m)
                last = m
        while b - last > MOST:
            last += MOST
            own.append(last)
        if b > last:
            own.append(b)
        out.append(np.array(own, np.int64))
    return out


class TextEncoder:
    """Ids of whole texts as the tokenizers library gives them, with special tokens split off before the pieces are found."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        splitter = made["pre_tokenizer"] or {}
        # The byte-level splitter without a prefix space cuts by pieces.PATTERN.
        if made["normalizer"] or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or splitter.get("use_regex") is False:
            raise ValueError("only byte-level tokenizers without a normalizer or a prefix space are provided for")
        special = tokenizer.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip for t in special.values()):
            raise ValueError("special tokens that take blanks or whole words only are not provided for")
        self.special = {t.content.encode(): i for i, t in special.items()}
        # Longer strings first, as the library prefers them.
        self.pattern = re.compile(b"|".join(re.escape(x) for x in sorted(self.special, key=lambda x: (-len(x), x))) or b"(?!)")
        self.pieces = Encoder(lambda pieces: [e.ids for e in tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)], REMEMBERED)

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one more at the end)."""
        buf, at = text_bytes(column)
        raw = buf.tobytes()
        if self.pattern.search(raw) is None:
            return self.pieces.ids(buf, at)
        found = [(m.start(), m.end(), self.special[m[0]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) for m in self.pattern.finditer(raw, a, b)]
        if not found:
            return self.pieces.ids(buf, at)
        start, end, special = np.array(found).T
        # Each special string is a stretch of its own; of the ids its pieces have, the first becomes its id and the rest go.
        border = np.sort(np.concatenate([at, start, end]))
        ids, first = self.pieces.ids(buf, border)
        own = np.searchsorted(border, start, side="right") - 1
        keep = np.ones(len(ids), bool)
        for a, b in zip(first[own].tolist(), first[own + 1].tolist()):
            keep[a + 1 : b] = False
        ids[first[own]] = special
        return ids[keep], np.append(0, np.cumsum(keep))[first[np.searchsorted(border, at)]]


def _encoder(path: str) -> TextEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


MANIFEST = "id long, range int, leaf long, start long, n int, payload binary, root binary"
ROWS = "kind string, key binary, id long, n int, payload binary"


def _chunked(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of kind chunk (key: digest) and, one a document, of kind recipe (key: its task and number, longer than a digest; payload: all digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        seen: set[bytes] = set()
        task, done = TaskContext.get().partitionId().to_bytes(8, "big"), 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids, at = encoder.ids(part.column("text"))
                ids = np.insert(ids, at[1:], END)
                at = at + np.arange(len(at))
                raw = ids.astype("<u2").tobytes()
                chunk: dict[str, list] = {"key": [], "n": [], "payload": []}
                recipe: dict[str, list] = {"n": [], "payload": []}
                for a, b, ends in zip(at[:-1].tolist(), at[1:].tolist(), cuts(ids, at)):
                    own, last = [], a
                    for e in ends.tolist():
                        payload = raw[2 * last : 2 * e]
                        own.append(digest(payload))
                        if own[-1] not in seen:
                            if len(seen) > 200_000:
                                seen.clear()
                            seen.add(own[-1])
                            chunk["key"].append(own[-1])
                            chunk["n"].append(e - last)
                            chunk["payload"].append(payload)
                        last = e
                    recipe["n"].append(b - a)
                    recipe["payload"].append(b"".join(own))
                m, k = len(chunk["key"]), part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["chunk"] * m + ["recipe"] * k),
                        pa.array(chunk["key"] + [task + b"-" + (done + i).to_bytes(8, "big") for i in range(k)], pa.binary()),
                        pa.concat_arrays([pa.nulls(m, pa.int64()), part.column("id")]),
                        pa.array(chunk["n"] + recipe["n"], pa.int32()),
                        pa.array(chunk["payload"] + recipe["payload"], pa.binary()),
                    ],
                    ["kind", "key", "id", "n", "payload"],
                )
                done += k

    return docs.select(nat("doc_id").alias("id"), "text").mapInArrow(run, ROWS)


def write(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Encode all texts, and write the store: one pass over the texts and one shuffle of distinct chunks."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(tokenizer).get_vocab_size()
    if known > IDS:
        raise ValueError(f"the vocabulary has {known} ids, and chunks hold ids of two bytes")
    # Tasks have told most copies of chunks apart already. Recipes pass through the same shuffle under keys of their own.
    unique = _chunked(docs, tokenizer).dropDuplicates(["key"])
    unique.write.option("compression", "zstd").partitionBy("kind").parquet(f"{folder}/data")
    started(_stored(spark, folder, "recipe").select("id", "n", "payload")).write.parquet(f"{folder}/manifest")
    rooted(manifest(spark, folder)).write.parquet(f"{folder}/roots")


def rooted(held: DataFrame) -> DataFrame:
    """Roots over a manifest: (range, leaf, documents, ids, root) of every LEAF documents, of each range (leaf null) and of all (range null).

    A group holds LEAF documents, the leaves of one range or the ranges: 4,096 ranges at most.
    """
    root = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, F.hex("root").alias("h")))), lambda x: x["h"]), ""), 256).alias("root")
    sums = [F.sum(c).cast("long").alias(c) for c in ("documents", "ids")]
    leaves = held.groupBy("range", "leaf").agg(F.count("*").alias("documents"), F.sum("n").cast("long").alias("ids"), root("start"))
    ranges = leaves.groupBy("range").agg(*sums, root("leaf"))
    top = ranges.groupBy(F.lit(None).cast("int").alias("range")).agg(*sums, root("range"))
    none = F.lit(None).cast("long").alias("leaf")
    names = ["range", "leaf", "documents", "ids", "root"]
    return leaves.unionByName(ranges.select("*", none)).unionByName(top.select("*", none)).select(names)


def roots(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("range int, leaf long, documents long, ids long, root string").parquet(f"{folder}/roots")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest, held against its roots by one join: ValueError if they differ, or either has one that the other lacks."""
    held = manifest(spark, folder)
    here, there = rooted(held).alias("here"), roots(spark, folder).alias("there")
    same = lambda c: F.col(f"here.{c}").eqNullSafe(F.col(f"there.{c}"))
    both = here.join(there, same("range") & same("leaf"), "full_outer")
    if not both.filter(~(same("documents") & same("ids") & same("root"))).isEmpty():
        raise ValueError("the manifest doesn't hold what its roots say")
    return held


def started(recipes: DataFrame) -> DataFrame:
    """The manifest in ascending id: id, range, leaf, start, n, root, payload (digests). Ranges of ids are summed apart and then offset."""
    bounds = range_bounds(recipes, "id", min(8 * parts(recipes.sparkSession), 4096))
    rows = recipes.withColumn("range", bucket_of(F.col("id"), bounds))
    sums = rows.groupBy("range").agg(F.sum("n").alias("total"))
    # One row a range, of which there are 4096 at most.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    order = Window.partitionBy("range").orderBy("id", "payload")
    prior = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    leaf = F.floor((F.row_number().over(order) - 1) / LEAF).cast("long")
    placed = rows.withColumns({"prior": prior, "leaf": leaf}).join(F.broadcast(offsets), "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([p[i : i + DIGEST] for i in range(0, len(p), DIGEST)]) for p in batch.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])

    out = placed.select("id", "range", "leaf", (F.col("offset") + F.col("prior")).cast("long").alias("start"), "n", "payload")
    return out.mapInArrow(run, MANIFEST).sortWithinPartitions("id")


def crc_combine(tables: dict[int, np.ndarray], crc: int, other: int, size: int) -> int:
    """crc32 of two stretches from theirs and the second's bytes: the first is moved on by that many zero bytes."""
    if size not in tables:
        tables[size] = _shift(size)
    moved, bit = 0, 0
    table = tables[size]
    while crc:
        if crc & 1:
            moved ^= table[bit]
        crc >>= 1
        bit += 1
    return moved ^ other


def _shift(size: int) -> list[int]:
    """What `size` zero bytes make of each bit of a crc32: linear, so that it can be had from zlib itself."""
    base = zlib.crc32(bytes(size), 0)
    return [zlib.crc32(bytes(size), 1 << i) ^ base for i in range(32)]


def _stored(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of one kind; the folders of kinds are there only if there are rows."""
    rows = spark.read.schema("key binary, id long, n int, payload binary, kind string").parquet(f"{folder}/data")
    return rows.filter(F.col("kind") == kind)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """digest, n, crc (of the ids as 32-bit) of every stored chunk, verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist()):
                if digest(payload) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't hold what its digest says")
                crc.append(zlib.crc32(np.frombuffer(payload, "<u2").astype("<u4")))
            yield pa.record_batch({"digest": batch.column("key"), "n": batch.column("n"), "crc": pa.array(crc, pa.int64())})

    return _stored(spark, folder, "chunk").select("key", "n", "payload").mapInArrow(run, "digest binary, n int, crc long")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def _recipes(held: DataFrame) -> DataFrame:
    """(id, start, n, root, seq, digest): one row a chunk of a document."""
    at = F.expr(f"sequence(0, cast(length(payload) div {DIGEST} AS int) - 1)")
    return held.select("id", "start", F.col("n").alias("ids"), "root", F.posexplode(F.transform(at, lambda i: F.substring(F.col("payload"), i * DIGEST + 1, F.lit(DIGEST)))).alias("seq", "digest"))


def checked(spark: SparkSession, folder: str) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files, each verified by its Merkle root, and these by the manifest's."""
    listed = _recipes(verified(spark, folder))
    # How often each chunk is listed tells which ones would be hot; one that isn't listed is not read.
    places = staged(listed.groupBy("digest").agg(F.count("*").alias("places")), "store-places")
    found = staged(places.join(chunks(spark, folder), "digest", "left"), "store-chunks")
    joined = joined_by(listed, found, ["digest"], places.agg(F.coalesce(F.sum("places"), F.lit(0))).first()[0])
    gathered = joined.groupBy("id", "start", "ids", "root").agg(F.collect_list(F.struct("seq", "digest", "n", "crc")).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, list[int]] = {}
        for batch in batches:
            crcs = []
            for own, ids, root, key in zip(*(batch.column(c).to_pylist() for c in ("own", "ids", "root", "id"))):
                own.sort(key=lambda x: x["seq"])
                if any(x["n"] is None for x in own) or sum(x["n"] for x in own) != ids or merkle([x["digest"] for x in own]) != root:
                    raise ValueError(f"document {key} can't be put together again")
                crc = own[0]["crc"]
                for x in own[1:]:
                    crc = crc_combine(tables, crc, x["crc"], 4 * x["n"])
                crcs.append(crc)
            yield pa.record_batch({"id": batch.column("id"), "start": batch.column("start"), "n_tokens": batch.column("ids").cast(pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return gathered.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def restored(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """id and ids (array<int>) of the documents whose id is in `wanted`, put together from their chunks and verified."""
    held = manifest(spark, folder).join(wanted.select("id").distinct(), "id", "left_semi")
    joined = _recipes(held).join(_stored(spark, folder, "chunk").select(F.col("key").alias("digest"), "payload"), "digest", "left")
    own = joined.groupBy("id", "start", "ids", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", "payload"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, n, root, own in zip(*(batch.column(c).to_pylist() for c in ("id", "ids", "root", "own"))):
                if any(x["payload"] is None or digest(x["payload"]) != x["digest"] for x in own) or merkle([x["digest"] for x in own]) != root:
                    raise ValueError(f"document {key} can't be put together again")
                out.append(np.frombuffer(b"".join(x["payload"] for x in own), "<u2").astype(np.int32))
                if len(out[-1]) != n:
                    raise ValueError(f"document {key} can't be put together again")
            yield pa.record_batch({"id": batch.column("id"), "ids": pa.array(out, pa.list_(pa.int32()))})

    return own.mapInArrow(run, "id long, ids array<int>")


def op6_token_store(spark, sf_dir: str) -> DataFrame:
    """All documents encoded into a store and read back from it."""
    import public_tokenizers

    folder = new_path(spark, "token-store")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    found = checked(spark, folder)
    return found.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
