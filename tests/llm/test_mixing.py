from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import mixing


def targets(sizes, weights=(5.0, 2.0, 1.0), share=1.5, most=2.0):
    """Excess over a source's limit is shared again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = {s: 0.0 for s in names}
    total, open_to = share * sum(sizes.values()), list(names)
    while open_to:
        left = total - sum(out[s] for s in names if s not in open_to)
        level = left / sum(weight[s] for s in open_to)
        full = [s for s in open_to if weight[s] * level >= most * sizes[s]]
        if not full:
            return {s: weight[s] * level if s in open_to else out[s] for s in names}
        for s in full:
            out[s] = most * sizes[s]
        open_to = [s for s in open_to if s not in full]
    return out


def documents(n=600, seed=1):
    rng = random.Random(seed)
    sources = ["s0"] * 6 + ["s1", "s2", "é", "Z", None, ""]
    return [
        (i, None if rng.random() < 0.02 else " ".join(["w"] * rng.choice([0, 1, 5, 40, 41, 200])), rng.choice(sources))
        for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_targets_and_totals(spark):
    rows = documents()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    found = mixing.mix(frame(spark, rows), block_rows=32).collect()
    assert len(found) == len(rows)
    want, taken, extra = targets(dict(sizes)), defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        extra[r.source] += r.copies if r.size else 0
    for s, t in want.items():
        assert abs(taken[s] - t) <= 41  # a document of middle size
        docs = sum(1 for _, x, y in rows if y == s and x)
        if sizes[s]:
            assert abs(extra[s] - docs * t / sizes[s]) <= 8


def test_reruns_agree_whatever_the_partitions(spark):
    rows = documents(300, 2)
    one = mixing.mix(frame(spark, rows).repartition(2), block_rows=16).collect()
    two = mixing.mix(frame(spark, rows).repartition(5), block_rows=16).collect()
    key = lambda r: (r.id, r.copies)
    assert sorted(map(key, one)) == sorted(map(key, two))


def test_flights_keep_both_totals():
    rng = np.random.default_rng(3)
    size = rng.integers(1, 500, 300).astype(float)
    prob = rng.random(300)
    out = mixing.fly(prob, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert (out * size).sum() == pytest.approx((prob * size).sum())
    assert out.sum() == pytest.approx(prob.sum())
    assert ((mixing.fly(np.full(5, 0.3), np.full(5, 7.0), rng) % 1) > 1e-9).sum() <= 1


def test_inclusion_follows_the_probabilities():
    size = np.array([3.0, 5.0, 9.0, 14.0, 20.0, 31.0] * 4)
    prob = np.linspace(0.1, 0.9, 24)
    mean = np.mean([mixing.fly(prob, size, np.random.default_rng(s)) for s in range(600)], axis=0)
    assert np.abs(mean - prob).max() < 0.08


def test_rows_of_the_mix(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, "c", "x"), (3, "", "x"), (4, "d e f", None)]
    docs = frame(spark, rows).withColumn("size", F.lit("clash"))
    found = mixing.mix(docs).collect()
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns
    assert again.count() == sum(r.copies for r in found) and len(found) == 5
    assert all(r.text for r in again.collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_rows(docs.limit(0)).count() == 0


def test_rows_of_the_mix_with_clashing_names(spark):
    rows = [(i, "a b c" + " d" * (i % 5), "x", -i, f"m{i}", "s", i, 1) for i in range(30)]
    rows += [(77, "a b c", "x", k, "m", "s", k, 1) for k in range(7)]
    names = "doc_id long, text string, source string, _size int, _mix_id string, _source string, _twin int, _again int"
    docs = spark.createDataFrame(rows, names)
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns
    found = again.collect()
    assert {tuple(r) for r in found} <= set(rows)
    assert len(found) == sum(r.copies for r in mixing.mix(docs).collect())
    other = mixing.mixed_rows(spark.createDataFrame(rows[::-1], names).repartition(5)).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, other))


def test_counts_of_words(spark):
    texts = ["a b", " a\t\tb\n", "", None, "é x y", "\x0b\x0c\r"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in docs.select(mixing.words(F.col("t"))).collect()] == [2, 2, 0, 0, 2, 0]
