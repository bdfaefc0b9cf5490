"""Each operator against a plain version, on the smallest tables and on rows that are odd on purpose."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, decontaminate, licenses, minhash, quality, sharding, store, substring, suffixes, warc
from corvane.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, ids string, __id string"


def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, body = prose(60), prose(400)
    near = body.split()
    near[100] = near[300] = "changed"
    texts = [
        None, "", " \t\n", "one", "the same few words", "The same few WORDS", body, body, " ".join(near), prose(200) + " " + passage, passage + " " + prose(150),
        "x " * 5000, "a" * 30000, prose(30000), "line one\nline one\n\nline two\nline one", "under the MIT license cc by nc. Apache License, Version 2",
        "it's we'll they've 'tis ''s don't\n 's  two   spaces\t\ttab 123abc   x\U0001f600", "\x85\x1c﻿" + prose(20), prose(25), "*" * 300,
        " ".join(passage.split()[:12]), " ".join(passage.split()[:13]), "a <|endoftext|> b<|endoftext|><|endoftext|>  <|endoftext", "<|endoftext|>",
    ]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s", None, 5, "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(None, passage, None, None, None, None, None, None), rows[6]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows):
    return list(dict.fromkeys((r[0], r[1]) for r in rows))


def table(spark, sf_dir, name, key, column):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(key, column).collect()]


def held(df, want, columns, key="doc_id"):
    got = {}
    for r in df.collect():
        value = tuple(r[c] for c in columns)
        assert got.setdefault(r[key], value) == value, "rows of one document differ"
    assert got == want


CASES = {
    "op2": (lambda d: sharding.sharded(d), brute.op2_base, ["size", "text_crc32"]),
    "op3": (lambda d: licenses.scanned(d), lambda x: brute.op3(x, licenses.BASE_PHRASES), ["n_words", "n_base", "first_word", "last_word", "base_labels"]),
    "op5": (
        lambda d: minhash.near_classes(d).select(F.when(F.col("id") > -(1 << 63), F.col("id")).alias("doc_id"), "n_shingles", F.when(F.col("component") > -(1 << 63), F.col("component")).alias("c"), (F.col("id") == F.col("component")).alias("k")),
        brute.op5,
        ["n_shingles", "c", "k"],
    ),
    "op7": (lambda d: substring.spans(d), brute.op7, ["n_words", "n_removed", "kept_sha256"]),
    "op8": (lambda d: quality.judged(d), brute.op8, ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]),
    "op9": (lambda d: suffixes.removed(d), brute.op9, ["n_bytes", "n_removed", "n_spans", "kept_sha256"]),
}


@pytest.mark.parametrize("name", CASES)
def test_given_tables(spark, sf_dir, name):
    run, plain, columns = CASES[name]
    rows = table(spark, sf_dir, "documents", "doc_id", "text")
    held(run(spark.read.parquet(f"{sf_dir}/documents.parquet")), plain(rows), columns)


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(odd, name):
    run, plain, columns = CASES[name]
    df = run(odd)
    held(df, plain(pairs(odd_rows())), columns)


@pytest.mark.parametrize("name", CASES)
def test_empty_table(empty, name):
    assert CASES[name][0](empty).count() == 0


def test_shards_are_near_equal_and_gapless(spark, sf_dir):
    rows = sharding.sharded(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8).toPandas()
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 8
    assert size.max() - size.min() <= rows["size"].max()
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_hot_group_is_spread(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot text")).otherwise(F.format_string("text %d", "id")).alias("text"))
    size = sharding.sharded(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).toPandas()["b"]
    assert len(size) == 8 and size.max() < 1.05 * size.min()


def items(spark, sf_dir):
    return table(spark, sf_dir, "benchmark", "item_id", "text")


def test_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute.op4(table(spark, sf_dir, "documents", "doc_id", "text"), items(spark, sf_dir))
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    held(decontaminate.verdicts(docs, bench), want, columns)
    clean = decontaminate.decontaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {d for d, v in want.items() if not v[-1]}


def test_decontamination_of_odd_rows_in_blocks(spark, odd, empty, monkeypatch):
    texts = [r[1] for r in odd_rows()]
    rows = [(1, texts[9]), (2, "Words few"), (3, None), (4, ""), (None, "one"), (5, " ".join(texts[9].split()[205:240])), (6, "words few"), (7, "version")]
    bench = spark.createDataFrame(rows, "item_id long, text string")
    columns = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = brute.op4(pairs(odd_rows()), rows)
    held(decontaminate.verdicts(odd, bench), want, columns)
    monkeypatch.setattr(decontaminate.blocks, "__defaults__", (13, 20))
    held(decontaminate.verdicts(odd, bench), want, columns)
    assert decontaminate.verdicts(empty, bench).count() == 0
    held(decontaminate.verdicts(odd, bench.limit(0)), brute.op4(pairs(odd_rows()), []), columns)


def bpe_wanted(rows):
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = {}
    for d, t in rows:
        ids = encoding.encode_ordinary(t or "")
        out[d] = (len(ids), brute.sha(",".join(map(str, ids)).encode()), brute.sha((t or "").encode()))
    return path, out


def test_bpe(spark, sf_dir, odd, empty):
    columns = ["n_tokens", "ids_sha256", "decoded_sha256"]
    path, want = bpe_wanted(table(spark, sf_dir, "documents", "doc_id", "text"))
    held(bpe.round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, ["doc_id"]), want, columns)
    _, want = bpe_wanted(pairs(odd_rows()))
    held(bpe.round_trip(odd, path, ["doc_id"]), want, columns)
    assert bpe.round_trip(empty, path, ["doc_id"]).count() == 0
    shared = spark.sparkContext.broadcast(bpe.load_ranks(path))
    back = bpe.decoded(bpe.encoded(odd, shared, ["doc_id"]), shared, ["doc_id"]).collect()
    texts = dict(pairs(odd_rows()))
    assert all(bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") for r in back)


def test_pieces_that_share_a_hash_are_encoded_apart(monkeypatch):
    from corvane.llm import pieces

    texts = ["one two three", "", "two  three one's", "four"]
    column = store.pa.array(texts)
    spell = lambda found: [list(x) for x in found]
    want = pieces.Encoder(spell).ids(*store.text_bytes(column))
    real = pieces.word_hashes
    # The first hash tells nothing apart but lengths.
    monkeypatch.setattr(pieces, "word_hashes", lambda b, s, e, base=None: (e - s).astype(np.uint64) if base is None else real(b, s, e))
    got = pieces.Encoder(spell).ids(*store.text_bytes(column))
    assert got[0].tolist() == want[0].tolist() == list("".join(texts).encode()) and got[1].tolist() == want[1].tolist()
    with pytest.raises(ValueError, match="split by"):
        pieces.expect(r"\w+")


def test_token_store(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(((r[0], r[1]) for r in odd_rows()), key=lambda x: brute.nat(x[0]))
    want, start = [], 0
    for d, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((brute.nat(d), start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    folder = new_path(spark, "store")
    store.write(odd, path, folder)
    got = sorted(tuple(r) for r in store.checked(spark, folder).collect())
    assert got == sorted(want)
    again = {r["id"]: list(r["ids"]) for r in store.restored(spark, folder, spark.createDataFrame([(5,), (13,), (22,)], "id long")).collect()}
    texts = dict(rows)
    assert again == {i: tokenizer.encode(texts[i], add_special_tokens=False).ids + [0] for i in (5, 13, 22)}
    assert 50256 in again[22]
    folder = new_path(spark, "store")
    store.write(empty, path, folder)
    assert store.checked(spark, folder).count() == 0


def test_damage_of_the_store_is_found(spark, odd, monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_path(spark, "store")
    store.write(odd, path, folder)
    chunks, held, roots = spark.read.parquet(f"{folder}/data/kind=chunk"), store.manifest(spark, folder), store.roots(spark, folder)
    wanted = held.select("id")

    def copy(chunks, held=held):
        other = new_path(spark, "store")
        for df, part in ((chunks, "data/kind=chunk"), (held, "manifest"), (roots, "roots")):
            df.write.parquet(f"{other}/{part}")
        return other

    turned = F.when(F.col("n") == F.lit(chunks.first()["n"]), F.reverse(F.col("payload").cast("string")).cast("binary")).otherwise(F.col("payload"))
    bad = copy(chunks.withColumn("payload", turned))
    with pytest.raises(Exception, match="doesn't hold what its digest says"):
        store.checked(spark, bad).collect()
    with pytest.raises(Exception, match="can't be put together again"):
        store.restored(spark, bad, wanted).collect()
    lost = copy(chunks.limit(1))
    for read in (store.checked(spark, lost), store.restored(spark, lost, wanted)):
        with pytest.raises(Exception, match="can't be put together again"):
            read.collect()
    for other in (held.filter("id <> 5"), held.withColumn("root", F.when(F.col("id") == 5, F.lit(b"x")).otherwise(F.col("root")))):
        with pytest.raises(ValueError, match="roots say"):
            store.checked(spark, copy(chunks, other))
    monkeypatch.setattr(store, "IDS", 1000)
    with pytest.raises(ValueError, match="two bytes"):
        store.write(odd, path, new_path(spark, "store"))


def test_what_a_task_decides_goes_past_the_buckets(spark):
    """A passage in every document: no bucket of its windows gets more than one run of it from a task."""
    from corvane.llm import repeats

    passage = " ".join(f"p{k}" for k in range(40))
    docs = spark.createDataFrame([(i, f"a{i} b{i} c{i} " * 6 + passage) for i in range(3000)], "doc_id long, text string").coalesce(2)
    rows, size = repeats.keyed(docs)
    assert size == sum(len(r["text"]) for r in docs.collect())
    packets = repeats._packed(rows.withColumn("__text", F.col("text")).select("__id", "__sub", "__text"), repeats.word_symbols, 13, 5, True, 50, True).collect()
    own, past = {}, {}
    for r in packets:
        kind = repeats.unpacked([r["payload"]])[0]
        (own if r["bucket"] < 50 else past).setdefault(r["bucket"], []).extend(kind.tolist())
    assert all(k in (repeats.RUN, repeats.SEEN, repeats.MARK) for x in own.values() for k in x)
    assert all(k in (repeats.DUP, repeats.OPEN, repeats.FIRST) for x in past.values() for k in x)
    assert sum(map(len, past.values())) > 9000 and max(map(len, own.values())) < 3 * sum(map(len, own.values())) / len(own)


def test_paths_are_nonbranching_and_verified(spark):
    prose = lambda a, n: " ".join(f"w{a}x{k}" for k in range(n))
    passage, fork = prose("p", 300), prose("f", 40)
    # The passage whole in 2, 3 and 4; its second half also after other words in 5, so that a way in branches in its middle.
    rows = [(1, prose(1, 30)), (2, f"{prose(2, 20)} {passage} {fork}"), (3, f"{passage} {prose(3, 20)}"), (4, f"{prose(4, 9)} {passage}"), (5, f"{prose(5, 50)} {' '.join(passage.split()[150:])} {fork}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in substring.spans(df).collect()}
    want = brute.op7(rows)
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == want
    assert [r["n_removed"] for _, r in sorted(got.items())] == [0, 0, 300, 300, 190]
    assert got[1]["paths"] == [] and not any(p["repeated"] for p in got[2]["paths"]) and all(any(p["repeated"] for p in got[d]["paths"]) for d in (3, 4, 5))
    at = {}
    for d, r in got.items():
        words = dict(rows)[d].split()
        for p in r["paths"]:
            at.setdefault((p["name"], p["n"]), []).append((p["repeated"], " ".join(words[p["first"] : p["first"] + p["n"]])))
    assert all(len({w for _, w in x}) == 1 and not all(r for r, _ in x) for x in at.values())
    # Few paths for many edges, the long ones at more places than one.
    assert max(n for _, n in at) > 100 and len(got[3]["paths"]) < 12
    edges = substring.staged(substring.strung(substring.repeats(*substring.keyed(df), substring.word_symbols, 13, 5, other=True, named=True)), "edges")
    degree = {r["edge"]: (r["one_in"], r["one_out"]) for r in substring.junctions(edges).collect()}
    ways = {}
    for r in edges.collect():
        ways.setdefault(r["edge"], (set(), set()))
        ways[r["edge"]][0].add(r["left"])
        ways[r["edge"]][1].add(r["right"])
    assert degree == {e: (len(i) == 1 and 0 not in i, len(o) == 1 and 0 not in o) for e, (i, o) in ways.items()}
    assert {(True, True), (True, False), (False, True)} <= set(degree.values())
    # Names that stand for different words are found out.
    bad = spark.createDataFrame([(1, [(0, 13, False, 7, 1, b"a")]), (2, [(3, 13, True, 7, 1, b"b")])], f"id long, paths {substring.PATHS}")
    with pytest.raises(ValueError, match="same words"):
        substring.verified(bad, "paths")
    # A repeated path without a first place, too.
    with pytest.raises(ValueError, match="no first"):
        substring.verified(bad.filter("id = 2"), "paths")
    assert substring.verified(bad.filter("id = 1"), "paths").count() == 1


@pytest.mark.parametrize("hot", [1, 64])
def test_every_repeated_path_has_its_first_place(spark, sf_dir, hot, monkeypatch):
    from corvane.llm import repeats

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").repartition(3)
    r = random.Random(hot)
    stock = [f"s{i}" for i in range(40)]
    # Few words, so that an anchor has many contents, with copies of whole texts among them.
    dense = [" ".join(r.choice(stock[:4]) if r.random() < 0.5 else "a" for _ in range(200)) for _ in range(30)]
    more = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(dense + dense[:12])], "doc_id long, text string")
    if hot == 1:
        # Workers don't see the patch: one packet, made and settled here.
        monkeypatch.setattr(repeats, "HOT", hot)
        packets = repeats.Packets(4, True, False, True)
        rows = sorted(enumerate(dense + dense[:12]))
        sym, at = repeats.word_symbols(pa.array([t.encode() for _, t in rows], pa.binary()))
        doc, lo, n, g, c = repeats.runs(sym, at, 13, 5, repeats.Polynomial)
        list(packets.add(doc.astype(np.int64), np.zeros(len(doc), np.int64), lo, n, g, c))
        batch = next(packets.flush())
        tables = [repeats.settle([p], True, False, True) for p in batch.column("payload").to_pylist()]
        firsts, later = set(), set()
        for t in tables:
            for state, blob in zip(t.column("state").to_pylist(), t.column("entries").to_pylist()):
                for e in repeats.entries([blob], True):
                    (firsts if state == repeats.RUN else later if state == repeats.DUP else set()).add((int(e["name"]), int(e["gram"])))
        assert later and later <= firsts
        return
    both = docs.unionByName(more)
    got = substring.spans(both).collect()
    rows = [tuple(x) for x in both.collect()]
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got} == brute.op7(rows)
    paths = [p for x in got for p in x["paths"]]
    first = {(p["name"], p["gram"], p["n"]) for p in paths if not p["repeated"]}
    assert any(p["repeated"] for p in paths) and all((p["name"], p["gram"], p["n"]) in first for p in paths if p["repeated"])


def test_pointers_name_contents():
    from corvane.llm import repeats

    r = np.random.default_rng(3)
    values = repeats.BYTE_VALUES[r.integers(0, 2, 3000)]
    values[1000:1500] = values[200:700]
    start = r.integers(0, 2700, 4000)
    end = start + r.integers(5, 60, 4000)
    for namer in (repeats.Pointers, repeats.Polynomial):
        names = namer(values, 5)
        for found in (names.span(start, end), names.first(start, end)):
            by = {}
            for a, b, x in zip(start.tolist(), end.tolist(), found.tolist()):
                by.setdefault((b - a, values[a:b].tobytes()), set()).add(x)
            assert all(len(x) == 1 for x in by.values())
        spans = {(b - a, values[a:b].tobytes()): x for a, b, x in zip(start.tolist(), end.tolist(), names.span(start, end).tolist())}
        assert len(spans) < len(start) and len({(k[0], x) for k, x in spans.items()}) == len(spans)


def test_lines_stay_lines_where_words_go(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, passage, 5), (2, f" one two\n{passage}\n\nthree\tfour \n", 5), (3, "as\nit is \n", 5), (4, None, None), (5, f"\n{passage}", 5)]
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, n_chars int")).collect()}
    assert got == {1: (passage, 5), 2: ("one two\n\nthree\tfour", 19), 3: ("as\nit is \n", 5), 4: (None, None), 5: ("", 0)}


def warc_wanted(rows):
    first = {}
    for p, h in rows:
        b = (h or "").encode()
        if len(b) >= 100:
            first[b] = min(first.get(b, brute.nat(p)), brute.nat(p))
    out = []
    for p, h in rows:
        b = (h or "").encode()
        to = first.get(b)
        revisit = to is not None and to != brute.nat(p)
        out.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    return out


def test_warc(spark, sf_dir):
    rows = [(4, "x" * 100), (2, "x" * 100), (9, "x" * 99), (8, "x" * 99), (7, None), (6, ""), (5, "\r\n\r\nContent-Length: 5\r\n\r\n" * 9), (3, "é" * 3_000_000), (4, "x" * 100)]
    pages = spark.createDataFrame([(p, None if p == 9 else f"http://a/\r\n{p}", h) for p, h in rows], "page_id long, url string, html string").repartition(3)
    back = warc.read(warc.written(pages, new_path(spark, "warc"))).collect()
    assert sorted(r[:1] + tuple(r[2:6]) for r in map(tuple, back)) == sorted(warc_wanted(rows))
    texts = dict(rows)
    assert all(bytes(r["payload"]).decode() == (texts[r["page_id"]] or "") for r in back if r["record_type"] == "response")
    clash = warc.written(pages.selectExpr("*", "1 AS digest", "2 AS payload", "3 AS id", "4 AS first", "5 AS refers_to", "6 AS path"), new_path(spark, "warc"))
    assert sorted(r[:1] + tuple(r[2:6]) for r in map(tuple, warc.read(clash).collect())) == sorted(warc_wanted(rows))
    with pytest.raises(Exception, match="its manifest says"):
        warc.read(clash.withColumn("records", F.col("records") + 1)).collect()
    none = warc.written(pages.limit(0), new_path(spark, "warc"))
    assert none.count() == 0 and warc.read(none).count() == 0
    given = table(spark, sf_dir, "pages", "page_id", "html")
    got = warc.op1_warc(spark, sf_dir).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(warc_wanted(given))


def test_warc_reader_refuses_damage():
    member = warc.record(1, "http://a", b"payload", hashlib.sha256(b"payload").hexdigest(), None)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:7], self.data[7:]
            return out

    assert [warc.parsed(m)[2] for m in warc.members(Stream(member * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.members(Stream(member[:-9])))
    raw = zlib.decompress(member, 31)
    with pytest.raises(ValueError, match="block digest"):
        warc.parsed(raw.replace(b"payload\r\n", b"PAYLOAD\r\n"))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parsed(raw[:-3])


def test_near_classes_with_large_nodes(spark, monkeypatch):
    r = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [r.choice(words) for _ in range(120)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(120)] = r.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(200 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(40)]
    rows += [(300 + i, " ".join(r.choice("ab") for _ in range(r.randint(5, 9)))) for i in range(60)]
    monkeypatch.setattr(minhash, "SMALL", 12)
    df = minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    got = {x["id"]: (x["n_shingles"], x["component"], x["id"] == x["component"]) for x in df.collect()}
    assert got == brute.op5(rows)


def test_no_cell_grows_with_a_dense_node(spark, monkeypatch):
    """Half of each text is a template: one node of unlinked documents, of which some are near copies."""
    r = random.Random(9)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"u{i}x{k}" for k in range(50)])) for i in range(900)]
    rows += [(2000 + i, rows[i][1].replace("x7", "y7")) for i in range(0, 900, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(minhash, "SMALL", 60)
    monkeypatch.setattr(minhash, "DEPTH", 1)
    got = {x["id"]: x["component"] for x in minhash.near_classes(df).collect()}
    assert got == {i: (i - 2000 if i >= 2000 else i) for i, _ in rows}
    # Every pair outside the main class in one cell, and none larger than asked for but by chance.
    crowd = [(0, 1, k, 7 if k < 500 else 1000 + k // 3, 1, 1200) for k in range(1200)]
    dealt = minhash.cells(spark.createDataFrame(crowd, "tree int, node long, key long, label long, units long, m long")).collect()
    held = {}
    for x in dealt:
        held.setdefault(x["node"], []).append((x["key"], x["side"]))
    assert max(map(len, held.values())) <= 1.6 * 60
    met = [tuple(sorted((a, b))) for own in held.values() for i, (a, s) in enumerate(own) for b, t in own[i + 1 :] if s == minhash.BOTH or s != t]
    assert len(met) == len(set(met)) == 1200 * 1199 // 2 - 500 * 499 // 2


def test_dense_nodes_of_several_trees_deal_pairs_once(spark, monkeypatch):
    """Each document is in a random half of three trees' dense nodes, and all are in a fourth's; some are of one class."""
    r = random.Random(5)
    monkeypatch.setattr(minhash, "SMALL", 60)
    crowd = [(t, 100 - t, k, 7 if k < 150 else 1000 + k // 2, 1, 600) for k in range(600) for t in range(4) if t == 2 or r.random() < 0.5]
    df = spark.createDataFrame(crowd, "tree int, node long, key long, label long, units long, m long").repartition(5)
    held = {}
    for x in minhash.cells(df).collect():
        held.setdefault(x["node"], []).append((x["key"], x["label"], x["side"], set(x["before"])))
    assert max(map(len, held.values())) <= 1.6 * 60
    met, dealt = [], 0
    for own in held.values():
        seen = minhash.marks(np.zeros(len(own), np.int64), pa.array([sorted(b) for *_, b in own], pa.list_(pa.int64())))
        for i, (a, la, sa, ba) in enumerate(own):
            for j, (b, lb, sb, bb) in enumerate(own[i + 1 :], i + 1):
                if sa == minhash.BOTH or sa != sb:
                    dealt += 1
                    assert (seen[i] & seen[j]).any() == bool(ba & bb)
                    if la != lb and not ba & bb:
                        met.append((min(a, b), max(a, b)))
    label = {k: x for _, _, k, x, *_ in crowd}
    pairs = {(a, b) for a in range(600) for b in range(a + 1, 600) if label[a] != label[b]}
    assert len(met) == len(set(met)) and set(met) == pairs
    every = sum(n * (n - 1) // 2 for n in (sum(t == x[0] for x in crowd) for t in range(4)))
    assert dealt < 0.9 * every


def test_recall_at_the_threshold(spark, monkeypatch):
    """Pairs just at 0.75 or above, in nodes that must branch."""
    r = random.Random(11)
    shared = [f"c{i}" for i in range(12)]
    rows = []
    for i in range(250):
        n = r.randint(40, 160)
        own = [f"w{i}x{k}" for k in range(n)]
        other = own[: round(n * r.uniform(0.87, 0.9))]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + other + [f"v{i}x{k}" for k in range(n - len(other))]))]
    want = brute.op5(rows)
    assert sum(not v[2] for v in want.values()) > 100
    monkeypatch.setattr(minhash, "SMALL", 12)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {x["id"]: (x["n_shingles"], x["component"], x["id"] == x["component"]) for x in minhash.near_classes(df).collect()} == want


def test_null_ids_are_documents_of_their_own(spark):
    prose = lambda a: " ".join(f"w{(a * 37 + k * k) % 9973}" for k in range(60))
    rows = [(None, prose(1), 1), (None, prose(2), 2), (None, prose(2) + " more", 3), (None, prose(3), 4), (None, prose(3), 5), (4, prose(5), 6), (4, prose(6), 7), (9, prose(6) + " more", 8), (10, "", 9), (11, None, 10), (None, None, 11), (None, None, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int").repartition(3)
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(None, prose(1)), (None, prose(3)), (4, prose(5)), (4, prose(6)), (10, ""), (11, None), (None, None), (None, None)]
    rest = [x for x in got if x not in want]
    assert len(got) == len(want) + 1 and rest[0][0] is None and rest[0][1].startswith(prose(2))


def test_thresholds_adapt_to_groups(spark):
    rows = [(i, " ".join(f"word{(i * 31 + k) % 997}" for k in range(40)), "en", "a") for i in range(400)]
    rows += [(1000 + i, " ".join(f"w{(i * 31 + k) % 997}#|" for k in range(40)), "en", "b") for i in range(400)]
    rows += [(5000, rows[0][1].replace("word", "#|"), "en", "a"), (5001, rows[400][1], "en", "b")]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(5000)
    assert all(got.values())


def test_spans_of_a_licence(spark):
    text = "some words " * 20 + licenses.TEMPLATES["mit-text"].upper() + " more words"
    row = licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["labels"] == "mit-text" and row["score"] == 1.0
    assert [(s["template"], s["first"]) for s in row["spans"]] == [("mit-text", 40)]


def test_licence_labels(spark, sf_dir, tmp_path):
    t = licenses.TEMPLATES
    plain = {
        1: ("released under the terms of a contract", ""),
        2: ("released under the GPL license", ""),
        3: ("code under the mit roof, all rights kept", ""),
        4: ("Released under the MIT License.", "mit,mit-line"),
        5: ("This program is free software; you can redistribute it", ""),
        6: (t["gpl-3-text"].replace("free", "Free"), "gpl-3-text"),
        7: (t["gpl-2-text"], "gpl-2-text"),
        8: (t["bsd-2-text"], "bsd-2-text"),
        9: ("x " + t["bsd-3-text"] + " and " + t["isc-text"], "bsd-3-text,isc-text"),
        10: (t["mit-text"].replace("sublicense", "other words here instead of it"), "mit-text"),
        11: (" ".join(t["mit-text"].split()[:20]), ""),
        12: ("This work is licensed under the GNU General Public License, version 3.", "gpl-3-line"),
        13: (None, ""),
    }
    rows = [(k, v[0]) for k, v in plain.items()]
    r = random.Random(4)
    pool = [x.split() for x in t.values()]
    for i in range(40):
        words = []
        for _ in range(r.randint(1, 5)):
            own = r.choice(pool)
            a = r.randrange(len(own))
            words += own[a : a + r.randint(2, 90)] + ["other"] * r.choice([0, 0, 1, 3])
        rows.append((100 + i, " ".join(words)))
    got = {x["doc_id"]: (x["labels"], x["score"]) for x in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k][0] for k in plain} == {k: v[1] for k, v in plain.items()}
    want = brute.op3_labels(rows, licenses.BASE_PHRASES, t)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-6 for k in want)
    # Whole licences from a folder, as a parameter.
    (tmp_path / "own.txt").write_text("The Own License\n\nDo as you like, but tell all of us of it.")
    own = licenses.load_templates(spark, f"file://{tmp_path}")
    out = licenses.scanned(spark.createDataFrame([(1, "see: THE OWN LICENSE do as you like but tell all of us of it!")], "doc_id long, text string"), own).first()
    assert out["labels"] == "own" and out["score"] == 1.0


def test_words_longer_than_a_step():
    from corvane.llm.words import word_hashes

    buf = np.frombuffer(("a" * 1000 + " bc " + "xyz" * 700).encode(), np.uint8)
    starts, ends = np.array([0, 1001, 1004]), np.array([1000, 1003, len(buf)])
    assert (word_hashes(buf, starts, ends, 64) == word_hashes(buf, starts, ends)).all()


def test_packing_of_whole_groups(spark):
    r = random.Random(5)
    rows = []
    for i in range(300):
        words = r.randint(1, 60)
        text = " ".join(r.choice(["a", "longer", "words-of-many-letters"]) + str(i) for _ in range(words))
        rows += [(1000 * i + c, text) for c in range(r.choice([1, 1, 1, 2, 6]))]
    got = sharding.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    text = dict(rows)
    assert {d: n for d, n in zip(got["doc_id"], got["tokens"])} == {d: len(brute.BLANK_WORD.findall(t)) for d, t in rows}
    # A plain packer of the same groups, from large to small: each to the highest dot product with what is left.
    group = {}
    for d, t in rows:
        v = group.setdefault(t, [0, 0, 0])
        for i, x in enumerate((len(t.encode()) + 1, len(brute.BLANK_WORD.findall(t)), 1)):
            v[i] += x
    total = [sum(v[i] for v in group.values()) for i in range(3)]
    load = sorted(([4 * x / y for x, y in zip(v, total)] for v in group.values()), key=max, reverse=True)
    left = [[1.0] * 3 for _ in range(4)]
    for v in load:
        fits = [all(a >= b for a, b in zip(x, v)) for x in left]
        score = [(f, sum(a * b for a, b in zip(x, v)) if any(fits) else x[0]) for f, x in zip(fits, left)]
        x = left[score.index(max(score))]
        for i in range(3):
            x[i] -= v[i]
    plain = [max(abs(x[i]) for x in left) for i in range(3)]
    own = got.groupby("shard").agg(size=("size", "sum"), tokens=("tokens", "sum"), rows=("size", "count"))
    assert got.assign(text=got["doc_id"].map(text)).groupby("text")["shard"].nunique().max() == 1
    for i, c in enumerate(("size", "tokens", "rows")):
        off = (4 * own[c] / total[i] - 1).abs().max()
        assert off <= plain[i] + 0.03, (c, off, plain[i])
