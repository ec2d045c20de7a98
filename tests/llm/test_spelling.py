from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tideline.llm import spelling
from tests.llm.brute import lower

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(docs):
    total = Counter()
    for key, text in docs:
        for run in RUN.findall(lower(text)):
            mark = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if mark % 97 == 0:
                at = mark % len(run)
                run = run[:at] + run[at + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def plain_variants(docs):
    words = plain_words(docs)
    rows = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        rows[w] = (n, len(near), form, words.get(form))
    out = set()
    for w, row in rows.items():
        root = w
        while rows[root][2] is not None:
            root = rows[root][2]
        out.add((w, *row, root))
    return out


def family(rng, letters, size):
    """Words a few edits apart from a handful of roots."""
    roots = ["".join(rng.choices(letters, k=rng.randint(5, 14))) for _ in range(max(1, size // 12))]
    out = set(roots)
    while len(out) < size:
        w = rng.choice(sorted(out))
        i = rng.randrange(len(w) + 1)
        w = rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :]])
        if 5 <= len(w) <= 20:
            out.add(w)
    return sorted(out)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdeé", "abcdefghijklmnop"])
@pytest.mark.parametrize("fixed", [2, 5, 7, 30])
def test_every_pair_shares_a_key(monkeypatch, letters, fixed):
    monkeypatch.setattr(spelling, "FIXED", fixed)
    words = family(random.Random(len(letters) + fixed), letters, 300)
    frequency = spelling._grams(words)
    index, probe = {}, {}
    for w in words:
        grams = spelling.prefix(w, frequency)
        assert len(grams) >= 3
        a, b = spelling.pivots(grams)
        assert b - a >= 2
        n = dict(grams)
        assert n[a] + n[b] == min(x + y for i, x in grams for j, y in grams if j - i >= 2)
        index[w] = spelling.keys(w, (a, b), True)
        probe[w] = spelling.keys(w, [p for p, _ in grams], False)
    pairs = [(v, w) for v in words for w in words if v < w and one_edit(v, w)]
    assert len(pairs) > 100
    for v, w in pairs:
        assert index[v] & probe[w] or index[w] & probe[v], (v, w)


def documents(seed, n=150, letters="abcdé"):
    rng = random.Random(seed)
    words = family(rng, letters, 160)
    weights = [1 / (i + 1) for i in range(len(words))]
    rng.shuffle(words)
    rows = []
    for i in range(n):
        picked = rng.choices(words, weights, k=rng.randint(0, 60))
        picked = [w.upper() if w.isascii() and rng.random() < 0.2 else w for w in picked]
        rows.append((i, "".join(w + rng.choice([" ", "-", "1", ". "]) for w in picked)))
    return rows


def found(frame):
    return {(r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in frame.collect()}


def test_variants_equal_a_plain_program(spark):
    rows = documents(1) + [(None, "abcde abcde abcde"), (7, None), (8, ""), (9, "Ünter Ünter ÜNter × ÷")]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = plain_variants(rows)
    assert any(r[3] for r in expected) and any(r[5] != r[3] for r in expected if r[3])
    assert found(spelling.variants(docs.selectExpr("*", "text AS word", "1 AS n", "2 AS key"))) == expected


def test_counts_are_handed_on_in_parts(spark):
    rows = documents(2, 40)
    batch = spark.createDataFrame(rows, "key string, text string").toArrow().to_batches()
    parts = list(spelling._word_counts(iter(batch)))
    old, spelling.TASK_WORDS = spelling.TASK_WORDS, 10
    try:
        more = list(spelling._word_counts(iter(batch)))
    finally:
        spelling.TASK_WORDS = old
    total = lambda parts: sum((Counter(dict(zip(*map(lambda c: c.to_pylist(), p.columns)))) for p in parts), Counter())
    assert len(more) > len(parts) and total(more) == total(parts)


def test_long_chains_of_forms(spark):
    """Each word is the form of the one before it; doubling finds the root of all."""
    words = ["a" * (5 + i) for i in range(9)]
    rows = [(w, 3 * 2**i) for i, w in enumerate(words)]
    table = spark.createDataFrame(rows, "word string, n long")
    forms = spelling.with_forms(table, spelling.near_words(table))
    assert {r.root for r in spelling.with_roots(forms).collect()} == {words[-1]}


def test_tables_that_grow_are_not_broadcast(spark):
    """Words are few bytes where their keys, links and forms are many rows: none goes by the driver."""
    words = spark.createDataFrame([("abcde", 9), ("abcdf", 4), ("abcdg", 4)], "word string, n long")
    forms = spelling.with_forms(words, spelling.near_words(words))
    roots = spelling.with_roots(forms)
    assert {(r.word, r.n_near, r.root) for r in roots.collect()} == {(w, 2, "abcde") for w in ("abcde", "abcdf", "abcdg")}
    plan = roots._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 3 and "Broadcast" not in plan


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0
