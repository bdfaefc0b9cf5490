"""Plain versions of the contracts, row by row, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

BLANK_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def nat(d):
    return -(1 << 63) if d is None else d


def sha(b):
    return hashlib.sha256(b).hexdigest()


def op2_base(docs):
    return {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs}


def op3(docs, phrases):
    out = {}
    for d, t in docs:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        at, labels = [], set()
        for label, phrase in phrases.items():
            p = phrase.split()
            hits = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        out[d] = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))
    return out


def op3_labels(docs, phrases, templates, min_run=3, cover=0.6, gap=12, short=12):
    """{doc_id: (labels, score)}: at each word the longest stretch that some template holds, chained in every possible way."""
    named = {k: ALNUM_WORD.findall(t.lower()) for k, t in templates.items()}
    held = Counter(w for t in named.values() for w in set(t))
    base = op3(docs, phrases)
    out = {}
    for d, text in docs:
        w = ALNUM_WORD.findall((text or "").translate(LOWER))
        longest = []
        for i in range(1, len(w) + 1):
            n = 0
            while n < i and any(w[i - n - 1 : i] == t[j - n - 1 : j] for t in named.values() for j in range(n + 1, len(t) + 1)):
                n += 1
            longest.append(n)
        ends = [(i + 1, n) for i, n in enumerate(longest) if n >= min_run and (i + 1 == len(w) or longest[i + 1] <= n)]
        best = []
        for k, t in named.items():
            weigh = lambda a, b: sum(1 / held[x] for x in t[a:b])  # noqa: E731, B023
            chains = []
            for stop, n in ends:
                for e in (e for e in range(n, len(t) + 1) if t[e - n : e] == w[stop - n : stop]):
                    new = (stop - n, stop, e, weigh(e - n, e))
                    for first, to, at, total in chains:
                        if e - n - gap <= at < e and stop - n - gap <= to < stop:
                            total += weigh(e - min(n, e - at, stop - to), e)
                            new = max(new, (first, stop, e, total), key=lambda c: c[3])
                    chains.append(new)
            if chains:
                top = max(chains, key=lambda c: round(c[3], 9))
                share = min(1.0, top[3] / weigh(0, len(t)))
                if share >= (1 - 1e-9 if len(t) <= short else cover):
                    best.append((round(share, 9), round(top[3], 9), top[0], top[1], k))
        taken = []
        for x in sorted(best, key=lambda x: (-x[0], -x[1], list(named).index(x[4]))):
            if not any(2 * (min(x[3], y[3]) - max(x[2], y[2])) > min(x[3] - x[2], y[3] - y[2]) and y[:2] != x[:2] for y in taken):
                taken.append(x)
        own = set(filter(None, base[d][-1].split(",")))
        out[d] = (",".join(sorted(own | {x[4] for x in taken})), max([x[0] for x in taken] + [1.0] * bool(own), default=0.0))
    return out


def op4(docs, items, n=13):
    index, short = {}, {}
    for k, t in items:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        for i in range(max(1, len(w) - n + 1)) if w else ():
            x = tuple(w[i : i + n])
            (index if len(x) == n else short).setdefault(x, set()).add(k)
    lengths = {len(x) for x in short} | {n}
    out = {}
    for d, t in docs:
        w = ALNUM_WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in lengths:
            for i in range(len(w) - size + 1):
                x = tuple(w[i : i + size])
                if k := (index if size == n else short).get(x):
                    hit |= set(range(i, i + size))
                    found |= k - {None}
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit) and 20 * len(hit) >= len(w))
    return out


def shingles(t):
    w = BLANK_WORD.findall((t or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def op5(docs):
    sets = [(nat(d), d, shingles(t)) for d, t in docs]
    parent = {k: k for k, _, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, (_, _, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, (k, _, s) in enumerate(sets):
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j][2]) - n):
                a, b = sorted((find(k), find(sets[j][0])))
                parent[b] = a
    back = {k: d for k, d, _ in sets}
    return {d: (len(s), back[find(k)], find(k) == k) for k, d, s in sets}


def op7(docs, n=13):
    first = {}
    words = {d: BLANK_WORD.findall(t or "") for d, t in docs}
    for d, w in words.items():
        for i in range(len(w) - n + 1):
            x = tuple(w[i : i + n])
            first[x] = min(first.get(x, nat(d)), nat(d))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < nat(d):
                gone |= set(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), sha(" ".join(kept).encode()))
    return out


def op8(docs):
    out = {}
    for d, t in docs:
        t = t or ""
        w = BLANK_WORD.findall(t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if BLANK_WORD.search(x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        out[d] = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), failed)
    return out


def op9(docs, n=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: nat(x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            x = b[i : i + n]
            if x in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(x)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone) if not g)))
    return out
