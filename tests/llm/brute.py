"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower(text):
    return (text or "").translate(_LOWER)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text, width=3):
    words = WORD.findall(lower(text))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def similar(a, b, num, den):
    return bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)


def components(texts, width=3, num=90, den=100):
    """Index of the component of each text, as its smallest member."""
    sets = [shingles(t, width) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        if similar(sets[i], sets[j], num, den):
            a, b = find(i), find(j)
            up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def repeated(texts, length):
    """For each text of bytes, which bytes lie in a string of ``length`` that starts twice."""
    places = {}
    for t, data in enumerate(texts):
        for i in range(len(data) - length + 1):
            places.setdefault(data[i : i + length], []).append((t, i))
    gone = [[False] * len(d) for d in texts]
    for found in places.values():
        if len(found) > 1:
            for t, i in found:
                gone[t][i : i + length] = [True] * length
    return gone


def lines_gone(rows, num=80, den=100):
    """Whether each line of each (id, text) has an earlier match; rows in order of ids."""
    seen, out = [], []
    for _, text in rows:
        gone = []
        for line in (text or "").split("\n"):
            words = set(WORD.findall(line))
            gone.append(any(similar(words, s, num, den) for s in seen))
            if words:
                seen.append(words)
        out.append(gone)
    return out
