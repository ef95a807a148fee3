"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

import numpy as np
import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return SPACED.findall(text or "")


def letters(text):
    return ALNUM.findall((text or "").translate(LOWER))


def simhash(text, size=4):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    counts = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def similar(a, b):
    """Whether sets of shingles are similar by 0.8 or more."""
    return a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b))


def groups(ids, near):
    """Least id reachable from each row, where near(i, j) links rows."""
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = top(i), top(j)
            if a != b and near(i, j):
                up[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
    return [ids[top(i)] for i in range(len(ids))]


def without_repeats(texts, size=35):
    split = [words(t) for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = True
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def tiled(a, b, least):
    """Words that greedy string tiling covers."""
    in_a, in_b, total = [False] * len(a), [False] * len(b), 0
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not in_a[i + k] and not in_b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best >= least:
                    found.append((i, j))
        if not found:
            return total
        for i, j in found:
            if not any(in_a[i : i + best]) and not any(in_b[j : j + best]):
                in_a[i : i + best] = in_b[j : j + best] = [True] * best
                total += best
