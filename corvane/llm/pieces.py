"""Byte-level pieces of texts (words with their leading blank), found for whole slices of texts at a time.

The split follows one pattern, PATTERN; `expect` refuses any other. Pieces are told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

from corvane.llm.words import OTHER as SECOND
from corvane.llm.words import word_hashes

#: Fixed value: the pattern that classes() and piece_spans() follow.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
#: Distinct pieces that a task remembers, of about 50 bytes each; beyond it forgets all and starts anew.
REMEMBERED = 400_000


def expect(pattern: str) -> None:
    if pattern != PATTERN:
        raise ValueError(f"texts are split by {PATTERN}, not by {pattern}")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point under the pattern that splits texts before the merges."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, np.uint8)
    for name, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(name, every):
            out[np.frombuffer(m[0].encode("utf-32-le"), "<u4")] = kind
    return out


def piece_spans(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all pieces of the texts in buf, and for each text the number of its first piece."""
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    if not len(lead):
        return lead, lead, np.zeros(len(at), np.int64)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), "<u4")
    n = len(points)
    kind = np.full(n + 1, 255, np.uint8)
    kind[:n] = classes()[points]
    text_at = np.searchsorted(lead, at)
    edge = np.zeros(n + 1, bool)
    edge[text_at] = True
    cut = edge.copy()
    cut[1:n] |= kind[1:n] != kind[: n - 1]
    # A run of blanks before something else gives up its last: a space goes to what follows, any other stands alone.
    after = np.flatnonzero(cut[1:n] & ~edge[1:n] & (kind[: n - 1] == SPACE)) + 1
    cut[after - 1] = True
    joined = after[points[after - 1] == 0x20]
    cut[joined] = False
    # The endings 's 't 'm 'd 're 've 'll, where a piece begins with the apostrophe and it stands alone.
    mark = np.flatnonzero((points == 0x27) & cut[:n])
    mark = mark[(mark + 1 < n)]
    mark = mark[(kind[mark + 1] == LETTER) & ~edge[mark + 1]]
    one = points[mark + 1]
    two = np.where((mark + 2 < n) & ~edge[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
    short = np.isin(one, [0x73, 0x74, 0x6D, 0x64])
    long = ((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
    cut[mark[short | long] + 1] = False
    cut[mark[short] + 2] = True
    cut[mark[long] + 3] = True
    starts = lead[np.flatnonzero(cut[:n])]
    return starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, at)


class Encoder:
    """Ids of texts by their distinct pieces: `encode` gets those not met before, all at once."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self.forget()

    def forget(self) -> None:
        self.known, self.again = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: np.ndarray, again: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.known) + len(hashes) > self.remembered:
            self.forget()
        ids = self.encode(pieces)
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(count.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), np.uint32)])
        self.flat[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        start = self.used + np.cumsum(count) - count
        self.used += total
        at = np.searchsorted(self.known, hashes)
        self.known, self.again, self.start, self.count = (np.insert(x, at, y) for x, y in ((self.known, hashes), (self.again, again), (self.start, start), (self.count, count)))

    def ids(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in buf, and where each text's begin (one more at the end)."""
        starts, ends, first = piece_spans(buf, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        unique, where, each = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        second = word_hashes(buf, starts, ends, base=SECOND)
        if len(self.known) + len(unique) > self.remembered:
            self.forget()
        spot = np.searchsorted(self.known, unique)
        new = np.ones(len(unique), bool)
        inside = spot < len(self.known)
        new[inside] = self.known[spot[inside]] != unique[inside]
        if new.any():
            raw = buf.tobytes()
            w = where[new]
            self._learn(unique[new], second[w], [raw[a:b] for a, b in zip(starts[w].tolist(), ends[w].tolist())])
            spot = np.searchsorted(self.known, unique)
        if len(odd := np.flatnonzero(self.again[spot][each] != second)):
            return self._apart(buf, starts, ends, first, spot[each], odd)
        start, count = self.start[spot][each], self.count[spot][each]
        upto = np.cumsum(count)
        out = self.flat[np.repeat(start - upto + count, count) + np.arange(upto[-1])]
        return out, np.append(0, upto)[first]

    def _apart(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, spot: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ids() returns where pieces (odd) share their first hash with another piece: these are encoded by themselves."""
        own = {i: self.encode([buf[starts[i] : ends[i]].tobytes()])[0] for i in odd.tolist()}
        each = [own[i] if i in own else self.flat[self.start[k] : self.start[k] + self.count[k]].tolist() for i, k in enumerate(spot.tolist())]
        return np.array([x for y in each for x in y], np.uint32), np.append(0, np.cumsum([len(y) for y in each]))[first]
