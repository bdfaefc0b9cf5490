"""The pipeline against plain versions of its stages, one after the other."""

import re

import brute
from test_advice import op8_kept
from test_contracts import bpe_wanted, items, odd_rows

import corpus_pipeline
from corvane.llm.common import staged


def plain(rows, bench):
    """rows: (doc_id, text, lang, source)."""
    good = op8_kept(rows)
    rows = [(d, t) for d, t, *_ in rows if good[d]]
    near = brute.op5(rows)
    rows = [(d, t) for d, t in rows if near[d][-1]]
    gone = brute.op7(rows)
    first = {}
    texts = {}
    for d, t in sorted(rows):
        pieces = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t or "")
        w = brute.BLANK_WORD.findall(t or "")
        cover = set()
        for i in range(len(w) - 12):
            x = tuple(w[i : i + 13])
            if first.setdefault(x, d) < d:
                cover |= set(range(i, i + 13))
        texts[d] = "".join(x for i, x in enumerate(pieces) if i not in cover).lstrip(" \t\n\v\f\r") if cover else t
        assert len(cover) == gone[d][1]
    hit = brute.op4(list(texts.items()), bench)
    return bpe_wanted([(d, t) for d, t in texts.items() if not hit[d][-1]])[1]


def test_pipeline_is_its_stages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    want = plain([tuple(r) for r in rows], items(spark, sf_dir))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want
    assert len(got) == len(want)


def test_stages_keep_the_columns_and_bear_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, __id string")
    for start in (docs, docs.limit(0)):
        out = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, out, sf_dir), name)
            assert out.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, out, sf_dir)
        assert last.count() == out.count()
        assert start is not docs or out.count() > 3
