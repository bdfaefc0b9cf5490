"""Operator 6 on the given table, against the tokenizers library text by text."""

import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corvane.llm import pieces
from corvane.llm.store import op6_token_store


def test_given_table_against_the_library(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    want, start = {}, 0
    for key, text in rows:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        want[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op6_token_store(spark, sf_dir).collect()} == want


def test_pieces_that_are_forgotten_are_learned_again():
    words = [f"w{i} " for i in range(400)]
    encoder = pieces.Encoder(lambda each: [list(p) for p in each], remembered=50)
    for part in (words[:30], words[20:60], words[:10], words[50:99]):
        raw = np.frombuffer("".join(part).encode(), np.uint8)
        ids, at = encoder.ids(raw, np.array([0, len(raw)]))
        assert ids.tolist() == raw.tolist() and at.tolist() == [0, len(raw)]
    assert len(encoder.known) <= 100
