from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest

from tests.llm.brute import repeated, sha
from tideline.llm import suffix_dedup


def ordered(text):
    marked = [(0, 0) if c == 0 else (1, i) if c == 1 else (c, 0) for i, c in enumerate(text)]
    return sorted(range(len(text)), key=lambda i: marked[i:])


def test_suffix_arrays_and_prefixes_equal_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        text = []
        for _ in range(rng.randint(1, 5)):
            spread = rng.choice([0, 1, 2, 5, 250])
            text += [rng.randint(2, 2 + spread) for _ in range(rng.randint(1, 14))] + [1]
        text[-1] = 0
        array = suffix_dedup.suffix_array(np.array(text, dtype=np.int16))
        assert array.tolist() == ordered(text)
        common = suffix_dedup.permuted_prefixes(np.array(text, dtype=np.int16), array)
        for x, y in zip(array[1:].tolist(), array[:-1].tolist()):
            n = 0
            while text[x + n] == text[y + n] and text[x + n] > 1:
                n += 1
            assert common[x] == n


def documents(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcd é", k=rng.choice([15, 20, 21, 30, 80]))) for _ in range(6)]
    out = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.4 else "".join(rng.choices("abcdefg h", k=rng.randint(0, 40))) for _ in range(4)]
        out.append("".join(parts))
    return out + ["a" * 100, "ab" * 60, "", None, "x" * 19, "x" * 20, out[0], out[0]]


def expected(rows, length):
    data = [(t or "").encode() for _, t in rows]
    gone = repeated(data, length)
    out = []
    for (i, _), raw, g in zip(rows, data, gone):
        spans = sum(1 for k in range(len(g)) if g[k] and not (k and g[k - 1]))
        out.append((i, len(raw), sum(g), spans, sha(bytes(b for b, x in zip(raw, g) if not x))))
    return sorted(out)


def check(spark, rows, length=20, gram=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_dedup.remove_repeats(docs, length=length, gram=gram)
    assert sorted(map(tuple, found.collect())) == expected(rows, length)


def test_removal_equals_brute_force(spark):
    for seed in (1, 2):
        check(spark, list(enumerate(documents(seed))))


def test_pieces_of_long_texts_and_windows_counted_alone(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_CONTEXTS", 1)
    check(spark, list(enumerate(documents(3))))


def test_long_texts_are_cut_into_overlapping_pieces(monkeypatch):
    text = "".join(random.Random(4).choices("abcdefgh", k=900)).encode()
    whole = list(suffix_dedup._runs([text], 20, 5))
    monkeypatch.setattr(suffix_dedup, "PIECE", 100)
    parts = list(suffix_dedup._runs([text], 20, 5))
    covered = [w for f in parts for a, n in zip(f["low"], f["windows"]) for w in range(a, a + n)]
    assert sorted(covered) == list(range(900 - 19))
    assert sum(f["windows"].sum() for f in whole) == 900 - 19


def test_repeated_rows_and_empty(spark):
    check(spark, [(1, "abcdefghij" * 2 + "tail"), (1, "abcdefghij" * 2 + "tail"), (2, "short")])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("contexts", "cell"), [(2, 4), (1, 3), (4, 1), (3, 100)])
def test_anchors_with_many_contexts_equal_brute_force(spark, monkeypatch, contexts, cell):
    monkeypatch.setattr(suffix_dedup, "ANCHOR_CONTEXTS", contexts)
    monkeypatch.setattr(suffix_dedup, "CELL", cell)
    rng = random.Random(5)
    passage = "".join(rng.choices("abcd", k=26))
    near = [f"{''.join(rng.choices('ef', k=3))}{passage[: rng.randint(16, 26)]}{i}" for i in range(12)]
    rows = list(enumerate(documents(6) + near + [f"{i}{passage}{i}" for i in range(12)] + [near[0], near[0]]))
    check(spark, rows)


def test_windows_of_many_contexts_are_not_rows_of_their_own():
    """A common passage made one row of each of its windows in each text."""
    rng = random.Random(7)
    texts = [bytes(rng.choices(range(97, 123), k=767)) for _ in range(20)]
    row = {"fp": 1, "ctx": range(20), "windows": 369 - 1, "offset": 368 - 1, "bytes": texts, "copies": 1}
    (found,) = suffix_dedup._cells(400, suffix_dedup.CELL)(iter([pd.DataFrame(row)]))
    assert found["windows"].sum() == 20 * 368  # each window in one cell
    assert len(found) <= 20 * (369 // suffix_dedup.CELL + 2)
