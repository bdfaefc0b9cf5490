"""Licence scans: matching statistics against a generalised suffix automaton of licence templates.

Every text is streamed as words through one automaton built from all templates. At each word it holds the longest
stretch ending there that occurs in some template; stretches of MIN_RUN words or more that the next word doesn't
lengthen are matches. Matches are chained along a template when their places in it rise and the gaps stay small, and a
chain that covers enough of a template labels the document. A word weighs the less the more templates hold it, and a
template of SHORT words or fewer must stand there whole: a few words of a licence's phrase in other company say nothing.
Of templates that claim the same stretch of a text the one covered best is taken. Words that occur in no template only
reset the automaton, so numpy skips them.

Templates are a parameter: the short notices below, or whole licence texts from a folder (`load_templates`). Base
phrases are counted exactly in the same pass, at all their places.

Null and empty texts have no words, no labels and score 0. Equal rows give equal results. Of chains that cover a
template equally the first in the text counts, of templates that cover a stretch equally all do. A very long text is
scanned whole, by one pass. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import slices, text_bytes
from corvane.llm.words import alnum_words, of_hash, word_hashes

# The base phrases, and licences' own words in their notices and, where they are short, whole texts.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
_GNU = "this program is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution {}this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_CC = "this work is licensed under a creative commons {} 4 0 international license to view a copy of this license visit http creativecommons org licenses {} 4 0"
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-2-text": _BSD.format(""),
    "bsd-3-text": _BSD.format("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "),
    "apache-2-text": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl-2-text": _GNU.format("general public license", "2"),
    "gpl-3-text": _GNU.format("general public license", "3"),
    "lgpl-2-1-text": _GNU.format("lesser general public license", "2 1"),
    "lgpl-3-text": _GNU.format("lesser general public license", "3"),
    "agpl-3-text": _GNU.format("affero general public license", "3"),
    "mpl-2-text": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-text": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented",
    "cc-by-text": _CC.format("attribution", "by"),
    "cc-by-sa-text": _CC.format("attribution sharealike", "by sa"),
    "cc-by-nc-text": _CC.format("attribution noncommercial", "by nc"),
    "cc-by-nd-text": _CC.format("attribution noderivatives", "by nd"),
    "cc-by-nc-sa-text": _CC.format("attribution noncommercial sharealike", "by nc sa"),
    "mit-line": "released under the mit license",
    "apache-2-line": "licensed under the apache license version 2 0",
    "gpl-3-line": "licensed under the gnu general public license version 3",
    "gpl-2-line": "licensed under the gnu general public license version 2",
    "cc-by-nc-line": "licensed under cc by nc 4 0",
    "cc-by-line": "licensed under cc by 4 0",
    "all-rights": "all rights reserved",
}

#: Words in a match, share of a template's weight that its chain covers, words that may lie between two matches of a chain,
#: and words up to which a template must be covered whole.
MIN_RUN, MIN_COVER, MAX_GAP, SHORT = 3, 0.6, 12, 12
ALL = 1 - 1e-9


def load_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Whole licence texts from a folder of <label>.txt files: configuration, whatever the size of the corpus."""
    rows = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt").select(F.input_file_name().alias("path"), "value").collect()
    return {r["path"].rsplit("/", 1)[-1].removesuffix(".txt"): r["value"] for r in rows}


def words_of(phrase: str) -> list[int]:
    """The hashes of a phrase's words, by the rule that texts are split by."""
    buf, at = text_bytes(pa.array([phrase]))
    low, starts, ends, _ = alnum_words(buf, at)
    return word_hashes(low, starts, ends).tolist()


class Automaton:
    """Generalised suffix automaton over word hashes; each state knows a place in each template where its stretches end."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        for k, words in enumerate(texts):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w)
                self.ends[last].setdefault(k, set()).add(i + 1)
        # What ends at a state's places ends there as its suffixes, too; stretches too short for a match need no places.
        for s in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            up = self.link[s]
            if up > 0 and self.length[up] >= MIN_RUN:
                for k, at in self.ends[s].items():
                    self.ends[up].setdefault(k, set()).update(at)
        self.places = [{k: sorted(at) for k, at in e.items()} for e in self.ends]

    def _state(self, length: int, link: int, nxt: dict[int, int]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: int) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return cur

    def matches(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of each stretch of MIN_RUN words or more that the next word does not lengthen."""
        state = length = 0
        for i, w in enumerate(words):
            before = (i, length, state)
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            else:
                state = length = 0
            if length <= before[1] and before[1] >= MIN_RUN:
                yield before
        if length >= MIN_RUN:
            yield len(words), length, state


class Scanner:
    def __init__(self, templates: Mapping[str, str]):
        hashed = {k: words_of(t) for k, t in templates.items()}
        if short := [k for k, w in hashed.items() if len(w) < MIN_RUN]:
            raise ValueError(f"templates of fewer than {MIN_RUN} words: {', '.join(short)}")
        self.names = list(hashed)
        self.automaton = Automaton(list(hashed.values()))
        held = Counter(w for words in hashed.values() for w in set(words))
        # The weight of a template's first words, for any number of them; and the share of all that must be covered.
        self.weight = [np.concatenate([[0.0], np.cumsum([1 / held[w] for w in words])]).tolist() for words in hashed.values()]
        self.need = [ALL if len(w) <= SHORT else MIN_COVER for w in hashed.values()]
        self.base = {k: np.array([of_hash(x) for x in p.split()], np.uint64) for k, p in BASE_PHRASES.items()}
        self.vocabulary = np.unique(np.array(list(held) or [0], np.uint64))

    def chained(self, hashes: np.ndarray, known: np.ndarray) -> dict[str, tuple[float, int, int]]:
        """For each template that a chain covers: share covered, and the chain's first and last word in the text."""
        best: dict[int, tuple[float, float, int, int]] = {}
        # For each template, by place in it, the chain that covers most up to there: (first word, end in text, weight covered).
        chains: dict[int, dict[int, tuple[int, int, float]]] = {}
        cut = np.flatnonzero(np.diff(known) > 1) + 1
        for run in np.split(known, cut):
            for end, length, state in self.automaton.matches(hashes[run].tolist()):
                stop = int(run[0]) + end
                for k, ends in self.automaton.places[state].items():
                    grown, weight = chains.setdefault(k, {}), self.weight[k]
                    for e in ends:
                        new = (stop - length, stop, weight[e] - weight[e - length])
                        # A match goes on from a chain that ends before it in the text and in the template, within the gap.
                        for t in range(max(0, e - length - MAX_GAP), e):
                            c = grown.get(t)
                            if c is not None and stop - length - MAX_GAP <= c[1] < stop:
                                total = c[2] + weight[e] - weight[e - min(length, e - t, stop - c[1])]
                                if total > new[2]:
                                    new = (c[0], stop, total)
                        old = grown.get(e)
                        if old is None or new[2] >= old[2] or old[1] < stop - length - MAX_GAP:
                            grown[e] = new
                        share = min(1.0, new[2] / weight[-1])
                        if share >= self.need[k] and share > best.get(k, (0.0,))[0]:
                            best[k] = (share, new[2], new[0], new[1])
        return self.taken(best)

    def taken(self, best: dict[int, tuple[float, float, int, int]]) -> dict[str, tuple[float, int, int]]:
        """Of chains that overlap by more than half of the shorter one, those covered best."""
        out: dict[int, tuple[float, float, int, int]] = {}
        for k, x in sorted(best.items(), key=lambda i: (-round(i[1][0], 9), -round(i[1][1], 9), i[0])):
            lost = (2 * (min(x[3], y[3]) - max(x[2], y[2])) > min(x[3] - x[2], y[3] - y[2]) and (round(y[0], 9), round(y[1], 9)) != (round(x[0], 9), round(x[1], 9)) for y in out.values())
            if not any(lost):
                out[k] = x
        return {self.names[k]: (round(x[0], 9), x[2], x[3]) for k, x in out.items()}

    def scan(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        buf, at = text_bytes(batch.column("text"))
        low, starts, ends, first = alnum_words(buf, at)
        hashes = word_hashes(low, starts, ends)
        n = batch.num_rows
        doc = np.repeat(np.arange(n), np.diff(first))
        count, lo, hi = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base = [set() for _ in range(n)]
        for label, phrase in self.base.items():
            p = np.flatnonzero(hashes[: len(hashes) - len(phrase) + 1] == phrase[0]) if len(hashes) >= len(phrase) else np.zeros(0, int)
            for k in range(1, len(phrase)):
                p = p[hashes[p + k] == phrase[k]]
            p = p[doc[p] == doc[p + len(phrase) - 1]] if len(p) else p
            d, place = doc[p], p - first[doc[p]]
            np.add.at(count, d, 1)
            np.minimum.at(lo, d, place)
            np.maximum.at(hi, d, place)
            for x in np.unique(d):
                base[x].add(label)
        spot = np.searchsorted(self.vocabulary, hashes)
        known = np.flatnonzero(self.vocabulary[np.minimum(spot, len(self.vocabulary) - 1)] == hashes)
        # Only stretches of MIN_RUN known words can hold a match.
        if len(known):
            fresh = np.flatnonzero(np.diff(known, prepend=-9) != 1)
            split = np.union1d(fresh, np.flatnonzero(np.diff(doc[known], prepend=-1)))
            size = np.diff(np.append(split, len(known)))
            known = known[np.repeat(size >= MIN_RUN, size)]
        spans: list[dict[str, tuple[float, int, int]]] = [{} for _ in range(n)]
        edges = np.searchsorted(known, first)
        for x in np.flatnonzero(np.diff(edges)):
            spans[x] = self.chained(hashes[first[x] : first[x + 1]], known[edges[x] : edges[x + 1]] - first[x])
        some = count > 0
        score = [max([s[0] for s in spans[x].values()] + ([1.0] if some[x] else []), default=0.0) for x in range(n)]
        return pa.record_batch(
            {
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "n_words": np.diff(first).astype(np.int64),
                "n_base": count,
                "first_word": pa.array(lo, mask=~some),
                "last_word": pa.array(hi, mask=~some),
                "base_labels": [",".join(sorted(b)) for b in base],
                "labels": [",".join(sorted(b | set(s))) for b, s in zip(base, spans)],
                "score": pa.array(score, pa.float64()),
                "spans": pa.array([[{"template": k, "first": v[1], "end": v[2], "share": v[0]} for k, v in sorted(s.items())] for s in spans], pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
            }
        )


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,first:bigint,end:bigint,share:double>>"


def scanned(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """For every document: its words, the base phrases' places, all labels, and the template spans that gave them."""
    templates = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            for part in slices(batch, "text"):
                yield scanner.scan(part)

    return docs.select("doc_id", "text").mapInArrow(run, RESULT)


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
