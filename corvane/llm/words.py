"""Vectorised words, hashes and byte-level pieces of Arrow text batches."""

from __future__ import annotations

import numpy as np

#: Separators of the two word rules of this subpackage; all are ASCII, so UTF-8 bytes can be told apart one by one.
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: An odd multiplier, so that powers of it have inverses modulo 2**64, and a random 64-bit value for each byte.
BASE = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.int64)) * 2 + 1
BYTE_VALUES = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: Another multiplier, for identifiers that are to agree only where a hash by BASE does and the contents are equal.
OTHER = int(_RNG.integers(1 << 62, 1 << 63, dtype=np.int64)) * 2 + 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


#: Longest table of powers that is kept; a longer one serves its caller only.
KEPT = 1 << 19


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i in 0..n."""
    if base in _POWERS and len(_POWERS[base][0]) > n:
        return _POWERS[base]
    made = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n + 1 + n // 8, np.uint64)
        p[1:] = x & (2**64 - 1)
        made.append(np.multiply.accumulate(p, out=p))
    if n < KEPT:
        _POWERS[base] = made[0], made[1]
    return made[0], made[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


class Rolling:
    """Hashes of any stretches of one sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: int = BASE):
        up, self.down = powers(len(symbols) + 1, base)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, q: int) -> np.ndarray:
        n = len(self.sums) - q
        return mix((self.sums[q:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_spans(buf: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and for each text the number of its first word (one more at the end).

    table: for each byte whether it belongs to a word. Words never cross the borders `at` of texts.
    """
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = table[buf]
    border = at[1:-1]
    first = inside[1:-1] & ~inside[:-2]
    first[border[border < len(buf)]] |= inside[1:-1][border[border < len(buf)]]
    last = inside[1:-1] & ~inside[2:]
    inner = border[(border > 0) & (border <= len(buf))] - 1
    last[inner] |= inside[1:-1][inner]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18, base: int = BASE) -> np.ndarray:
    """A 64-bit hash of each word, in steps over bounded stretches of buf: memory doesn't grow with the longest word."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + step, side="right")))
        a = int(starts[i])
        if ends[i] - a > step:
            out[i] = _long_hash(buf, a, int(ends[i]), step, base)
            i += 1
            continue
        out[i:j] = Rolling(BYTE_VALUES[buf[a : ends[j - 1]]], base).span(starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def _long_hash(buf: np.ndarray, a: int, b: int, step: int, base: int) -> int:
    """What Rolling says of buf[a:b] as one stretch, from its parts."""
    total = 0
    for s in range(a, b, step):
        part = BYTE_VALUES[buf[s : min(b, s + step)]]
        total += int((part * powers(len(part), base)[0][: len(part)]).sum()) * pow(base, s - a, 1 << 64)
    return int(mix(np.array([total % (1 << 64)], np.uint64))[0])


def alnum_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) words of digits, letters a-z and non-ASCII characters: bytes, starts, ends, first word of each text."""
    low = LOWER[buf]
    return (low, *word_spans(low, at, ALNUM))


def of_hash(phrase: str) -> int:
    b = np.frombuffer(phrase.encode(), np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])
