"""Substring dedup by de Bruijn compaction of token k-mers, on super-k-mers as edges.

The k-mers of all texts are the edges of a de Bruijn graph. They are not laid out one by one:

1. A run of neighbouring k-mers with one anchor is a path of the graph already (a super-k-mer), and all copies of it fall
   into the bucket of its anchor. There those that occur once are dropped; super-k-mers that differ under one anchor are
   taken apart into single k-mers (see repeats.py). What occurs again is an edge of the graph from here on, at all its
   places: the first and the later ones, with the neighbours to its left and right.
2. An aggregate by edge tells its in- and out-degree and the first document that has it, and a join by edge brings them
   back to all its places. An edge is repeated wherever its first document is an earlier one.
3. Neighbours with one way out and one way in between them compact to a nonbranching path. They have the same places, so a
   path is the same stretch at all of these, one of which is in the first document.
4. A join by document brings the paths to their words. Every path is spelled out at all its source coordinates, and
   digests of the words are held against each other: a path whose places differ, or that is repeated and has no first
   place, is an error. Words under repeated paths go.

Edges are named by 96 bits of hashes: among 10^11 of them, two contents share a name with a probability of 1 in 10^7.

Words are split at ASCII blanks and kept as they are. Null text has no words. Different texts under one doc_id are
documents of their own, none earlier than the other; a null id comes before all others. Equal rows are one document, so
neither loses words to the other. A very long text is a slice of its own. Other columns are not read and may have any
names (`deduplicated` keeps them). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import joined_by, schema_of, staged
from corvane.llm.repeats import NAMED, covered, keyed, packed_texts, repeats, unpacked_text, word_symbols
from corvane.llm.words import mix

#: Words in an edge (a k-mer) and in an anchor.
EDGE, ANCHOR = 13, 5
#: Edges whose paths are told at once.
EDGES = 1 << 16
#: A word with the blanks before it; what counts as blank.
BLANKS = b" \t\n\v\f\r"
PIECE = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
PATHS = "array<struct<first:bigint,n:bigint,repeated:boolean,name:bigint,gram:int,digest:binary>>"
PATH = pa.struct([("first", pa.int64()), ("n", pa.int64()), ("repeated", pa.bool_()), ("name", pa.int64()), ("gram", pa.int32()), ("digest", pa.binary())])


def strung(found: DataFrame) -> DataFrame:
    """The graph's edges at all their places: __id, __sub, level, edge, gram (its name), left and right (neighbouring edges; 0: none), lo, n (windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("own")
            blobs = column.flatten()
            size = pc.binary_length(blobs).to_numpy(zero_copy_only=False) // NAMED.itemsize
            row = np.repeat(np.repeat(np.arange(batch.num_rows), pc.list_value_length(column).to_numpy(zero_copy_only=False)), size)
            e = np.frombuffer(b"".join(blobs.to_pylist()), NAMED)
            if not len(e):
                continue
            order = np.lexsort((e["lo"], row))
            e, row = e[order], row[order]
            # Equal rows of the table tell every place twice.
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (e["lo"][1:] != e["lo"][:-1])])
            e, row = e[new], row[new]
            lo, n = e["lo"].astype(np.int64), e["n"].astype(np.int64)
            meets = (row[1:] == row[:-1]) & (lo[1:] == lo[:-1] + n[:-1])
            short = np.maximum(mix(e["name"] + mix(e["gram"].astype(np.uint64))), np.uint64(1)).view(np.int64)
            left, right = np.zeros((2, len(e)), np.int64)
            left[1:][meets], right[:-1][meets] = short[:-1][meets], short[1:][meets]
            who = pa.array(row)
            own = (np.ascontiguousarray(e["name"]).view(np.int64), np.ascontiguousarray(e["gram"]).view(np.int32), left, right, lo.astype(np.int32), n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(who) for c in ("__id", "__sub", "level")), *map(pa.array, own)], ["__id", "__sub", "level", "edge", "gram", "left", "right", "lo", "n"]
            )

    per = found.groupBy("__id", "__sub", "level").agg(F.collect_list("entries").alias("own"))
    return per.mapInArrow(run, "__id long, __sub long, level int, edge long, gram int, left long, right long, lo int, n int")


def junctions(edges: DataFrame) -> DataFrame:
    """(edge, gram, places, first, one_in, one_out): an edge's number of places and first document, and whether all places have
    the same neighbour to the left, and to the right."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("left", "right") for n, f in (("lo", F.min), ("hi", F.max))]
    one = lambda c: (F.col(f"lo_{c}") == F.col(f"hi_{c}")) & (F.col(f"lo_{c}") != 0)
    told = edges.groupBy("edge", "gram").agg(*ends, F.count("*").alias("places"), F.min("__id").alias("first"))
    return told.select("edge", "gram", "places", "first", one("left").alias("one_in"), one("right").alias("one_out"))


def _with_paths(docs: DataFrame, text: str, k: int, q: int) -> DataFrame:
    """docs with the column `text` packed and __paths, the nonbranching paths of its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("edges")).to_numpy(zero_copy_only=False).astype(np.int64)
            # A few documents at a time: a batch of them may have millions of edges.
            turn = np.cumsum(size) // EDGES
            cut = np.flatnonzero(np.diff(turn, prepend=-1, append=-1)).tolist()
            for a, b in zip(cut[:-1], cut[1:]):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__sub"), compacted(part.column("edges"))], ["__id", "__sub", "__paths"])

    rows, size = keyed(docs)
    edges = staged(strung(repeats(rows, size, word_symbols, k, q, other=True, named=True)), "substring-edges")
    degrees = staged(junctions(edges), "substring-degrees")
    told = joined_by(edges.drop("left", "right"), degrees, ["edge", "gram"], edges.count())
    # Three numbers an edge: its place, its name's first half, and the rest of it with level and flags.
    flags = sum((c.cast("long") * x for c, x in ((F.col("level"), 8), (F.col("__id") > F.col("first"), 4), (F.col("one_in"), 2), (F.col("one_out"), 1))), F.col("gram").cast("long") * 256)
    place = F.col("lo").cast("long") * (1 << 16) + F.col("n")
    per = told.groupBy("__id", "__sub").agg(F.collect_list(F.struct(place.alias("place"), "edge", flags.alias("flags"))).alias("edges"))
    own = per.mapInArrow(run, "__id long, __sub long, __paths array<struct<lo:int,n:int,dup:boolean,edge:bigint,gram:int>>")
    if text != "text":
        rows = rows.drop("text")
    return packed_texts(rows, text).join(own, ["__id", "__sub"], "left").drop("__id", "__sub")


def compacted(column: pa.Array) -> pa.Array:
    """For each row's edges the nonbranching paths they make: first window, windows, repeated, name (edge and gram of its first edge)."""
    flat = column.flatten()
    row = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    place, edge, flags = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    level = flags >> 3 & 31
    order = np.lexsort((place, level, row))
    row, level, place, edge, flags = (x[order] for x in (row, level, place, edge, flags))
    lo, n, one_in, one_out = place >> 16, place & 0xFFFF, flags & 2 > 0, flags & 1 > 0
    goes_on = (row[1:] == row[:-1]) & (level[1:] == level[:-1]) & (lo[1:] == lo[:-1] + n[:-1]) & one_out[:-1] & one_in[1:]
    at = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    cut = np.searchsorted(row[at], np.arange(len(column) + 1)).astype(np.int32)
    paths = [lo[at].astype(np.int32), np.add.reduceat(n, at).astype(np.int32), flags[at] & 4 > 0, edge[at], (flags[at] >> 8).astype(np.int32)]
    return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays([pa.array(x) for x in paths], ["lo", "n", "dup", "edge", "gram"]))


def paths_of(column: pa.Array) -> Iterator[tuple[np.ndarray, ...] | None]:
    """Each row's paths as columns; None: it has none."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    columns = [column.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(5)]
    end = np.cumsum(size)
    return (tuple(x[b - m : b] for x in columns) if m else None for b, m in zip(end.tolist(), size.tolist()))


def spelled(words: list[bytes], paths: tuple[np.ndarray, ...], k: int) -> list[dict]:
    """The paths of one text with a digest of the words under each."""
    digest = lambda a, b: hashlib.blake2b(b" ".join(words[a:b]), digest_size=16).digest()
    return [{"first": a, "n": m + k - 1, "repeated": r, "name": e, "gram": g, "digest": digest(a, a + m + k - 1)} for a, m, r, e, g in zip(*(x.tolist() for x in paths))]


def verified(rows: DataFrame, paths: str) -> DataFrame:
    """Staged rows, once every path has been found to hold the same words at all its places, a first one among them: ValueError if one doesn't."""
    each = rows.select(F.inline(paths)).groupBy("name", "gram", "n").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi"), F.min("repeated").alias("alone"))
    if wrong := each.filter("lo <> hi OR alone").first():
        raise ValueError(f"path {wrong['name']} of {wrong['n']} words doesn't hold the same words at all its places, or has no first one")
    return rows


def spans(docs: DataFrame, k: int = EDGE, q: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and the nonbranching paths (first word, words, whether repeated, name) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, paths in zip(batch.column("text").to_pylist(), paths_of(batch.column("__paths"))):
                words = (unpacked_text(packed) or b"").split()
                kept, told = words, []
                if paths is not None:
                    told = spelled(words, paths, k)
                    kept = list(compress(words, ~covered(paths[0][paths[2]], paths[1][paths[2]], k, len(words))))
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), told))
            n, removed, digest, told = zip(*rows) if rows else ((), (), (), ())
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(told, pa.list_(PATH))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "paths"])

    rows = _with_paths(docs.select("doc_id", "text"), "text", k, q)
    out = rows.select("doc_id", "text", "__paths").mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string, paths {PATHS}")
    return verified(staged(out, "substring-spans"), "paths")


def deduplicated(docs: DataFrame, k: int = EDGE, q: int = ANCHOR) -> DataFrame:
    """docs, all columns, with repeated words taken out of the texts that hold any. What is left keeps the blanks that stood
    before it, so lines stay lines; n_chars, where docs has it as a number, follows."""
    names = docs.columns
    inner = docs.toDF(*[f"__c{i}" for i in range(len(names))])
    at = {c: F.col(f"__c{i}") for i, c in enumerate(names)}
    text, columns = f"__c{names.index('text')}", inner.columns
    rows = _with_paths(inner.select("*", at["doc_id"].alias("doc_id"), at["text"].alias("text")), text, k, q).drop("doc_id")
    count = f"__c{names.index('n_chars')}" if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (T.LongType, T.IntegerType)) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, told, touched = [], [], {}
            for i, (packed, paths) in enumerate(zip(batch.column(text).to_pylist(), paths_of(batch.column("__paths")))):
                raw = unpacked_text(packed)
                told.append([])
                if raw is not None and paths is not None:
                    pieces = PIECE.findall(raw)
                    told[-1] = spelled([x.lstrip(BLANKS) for x in pieces], paths, k)
                    gone = covered(paths[0][paths[2]], paths[1][paths[2]], k, len(pieces))
                    if gone.any():
                        raw = b"".join(compress(pieces, ~gone)).lstrip(BLANKS)
                        touched[i] = len(raw.decode())
                texts.append(None if raw is None else raw.decode())
            new = {text: pa.array(texts, pa.string())}
            if count and touched:
                kept = batch.column(count)
                new[count] = pa.array([touched.get(i, x) for i, x in enumerate(kept.to_pylist())], kept.type)
            yield pa.RecordBatch.from_arrays([*(new.get(c, batch.column(c)) for c in columns), pa.array(told, pa.list_(PATH))], [*columns, "__spelled"])

    schema = T.StructType([*inner.schema.fields, *schema_of(f"__spelled {PATHS}").fields])
    out = rows.select(*columns, "__paths").mapInArrow(run, schema)
    return verified(staged(out, "substring-texts"), "__spelled").select(*columns).toDF(*names)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What 13-word windows of earlier documents take out of every document."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("paths")
