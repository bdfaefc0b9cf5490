"""Suffix-array dedup by bucket-pointer refinement on sampled suffixes.

Suffixes begin at every byte, but only those that begin at an anchor are sorted at first: each string of the length asked
for holds one, at the same place in all its copies (see repeats.py).

1. Sampled suffixes are put in buckets by their opening q-gram.
2. Buckets are refined by sorting on the bucket identifiers of other offsets: the stretch within reach of a suffix is
   covered by two buckets of 2q, 4q, ... bytes, whose identifiers come from those of half the length, the second at a
   later offset (`Pointers`). An identifier is a hash of contents rather than a rank, so a pointer to the bucket at a
   later offset is had in place, without a join.
3. A bucket that this leaves with one content is settled, and that is reused: its suffixes take no further part, and
   copies within it are known whole. The rest is taken up again at every single offset within reach: buckets by the
   opening stretch, refined by the identifier at the later offset that reaches the string's end. Then all is settled.

Texts are UTF-8 bytes; null is empty. Different texts under one doc_id are documents of their own, in the order of
a digest; a null id comes before all others. Equal rows are one document, so both lose the same bytes. A very long text
is handled in stretches of some 260,000 bytes. Other columns are not read, whatever their names. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.repeats import Pointers, byte_symbols, covered, entries, gathered, keyed, packed_texts, repeats, unpacked_text

#: Bytes of a string that is removed where it stands again, and of a bucket's opening q-gram.
LENGTH, GRAM = 100, 40


def removed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the remaining bytes) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, blobs in zip(batch.column("text"), batch.column("__dup")):
                raw = unpacked_text(text.as_py()) or b""
                left, n, spans = raw, 0, 0
                if blobs.is_valid:
                    found = entries(blobs.as_py())
                    gone = covered(found["lo"], found["n"], length, len(raw))
                    left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    n, spans = int(gone.sum()), int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=0) == 1))
                rows.append((len(raw), n, spans, hashlib.sha256(left).hexdigest(), left))
            size, n, spans, digest, left = zip(*rows) if rows else ((),) * 5
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id").cast(pa.int64()),
                    "n_bytes": pa.array(size, pa.int64()),
                    "n_removed": pa.array(n, pa.int64()),
                    "n_spans": pa.array(spans, pa.int64()),
                    "kept_sha256": pa.array(digest, pa.string()),
                    "kept": pa.array(left, pa.binary()),
                }
            )

    rows, size = keyed(docs.select("doc_id", "text"))
    joined = packed_texts(rows, "text").join(gathered(repeats(rows, size, byte_symbols, length, gram, other=False, namer=Pointers)), ["__id", "__sub"], "left")
    return joined.select("doc_id", "text", "__dup").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What 100-byte strings that stand earlier take out of every document."""
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")
