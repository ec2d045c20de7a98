from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import knn_join


def brute(rows, k, step):
    def whole(v):
        if not v or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    vecs = {i: whole(v) for i, v in rows if whole(v)}
    out = []
    for q in vecs:
        if q % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(vecs[q], vecs[c])), c) for c in vecs if c != q)
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(seed, n=300, dim=6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(40)]  # a common vector: ties go to smaller ids
    rows += [(n + 100, None), (n + 101, [1.0, None] + [0.0] * (dim - 2)), (n + 102, [float("nan")] * dim)]
    return rows + [(n + 103, [float("inf")] + [0.0] * (dim - 1)), (n + 200, [0.0] * dim)]


@pytest.mark.parametrize("group_rows, slab_rows", [(512, 50_000), (3, 60)])
def test_best_k_equal_brute_force(spark, group_rows, slab_rows):
    rows = vectors(1)
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = knn_join.top_k(
        data, F.col("id") % 10 == 0, k=7, pivots=8, group_rows=group_rows, slab_rows=slab_rows
    )
    assert sorted(map(tuple, found.collect())) == brute(rows, 7, 10)


def sent_share(rows, pivots, k=3, step=20):
    """Share of all (query, row) pairs that the bounds leave, and the largest cell's share."""
    vecs = np.array([[math.floor(1024 * x) for x in v] for _, v in rows], float)
    cell, dist = knn_join._nearest(vecs, pivots)
    summary = {int(c): sorted(dist[cell == c])[: k + 1] for c in set(cell.tolist())}
    least = knn_join.least_distances(vecs[::step], pivots, summary, float(dist.max()), k)
    return (dist[None, :] >= least[:, cell]).mean(), np.bincount(cell).max() / len(rows)


def test_few_rows_of_clustered_vectors_are_sent(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in rng.choice(centres)]) for i in range(2000)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pivots = knn_join.choose_pivots(knn_join.whole_vectors(data, "vec_id", "embedding"), 64)
    share, _ = sent_share(rows, pivots)
    assert share < 0.2


def test_cells_of_vectors_of_equal_norm_are_balanced(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(2000, 32))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pivots = knn_join.choose_pivots(knn_join.whole_vectors(data, "vec_id", "embedding"), 64)
    assert sent_share(rows, pivots)[1] < 0.1


def test_slabs_hold_every_ring_in_bounds():
    slabs = knn_join.Slabs({0: (0.0, 8.0, 4), 1: (1.0, 1.0, 1)}, 10)
    assert slabs.ring(np.array([0, 0, 0, 1]), np.array([0.0, 2.0, 8.0, 1.0])).tolist() == [0, 1, 3, 0]
    slabs.lay([(0, 0, 4, 1.0), (0, 1, 5, 3.0), (0, 2, 25, 5.0), (0, 3, 6, 8.0), (1, 0, 3, 1.0)])
    assert slabs.first == {(0, 0): 0, (0, 1): 0, (0, 2): 1, (0, 3): 4, (1, 0): 4}
    assert slabs.parts == {(0, 0): 1, (0, 1): 1, (0, 2): 3, (0, 3): 1, (1, 0): 1}


def test_near_cells_with_few_queries_share_a_group():
    pivots = np.array([[0.0], [10.0], [1.0], [11.0], [2.0]])
    found = knn_join.bundles([(0, 3), (1, 4), (2, 3), (3, 25), (4, 4)], pivots, 10)
    assert found == [(0, 0, 1), (2, 0, 1), (4, 0, 1), (1, 1, 1), (3, 2, 3)]
    assert knn_join.bundles([], pivots, 10) == []


def test_unequal_lengths_repeated_ids_and_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 2.0**20 for _ in range(rng.choice([2, 3, 5]))]) for i in range(120)]
    data = spark.createDataFrame(rows + [rows[7]] * 30, "vec_id long, embedding array<double>").repartition(3)
    found = knn_join.top_k(data, F.col("id") % 10 == 0, k=5, pivots=6, group_rows=4, slab_rows=25)
    padded = [(i, v + [0.0] * (5 - len(v))) for i, v in rows]
    assert sorted(map(tuple, found.collect())) == brute(padded, 5, 10)


def test_few_rows_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    two = spark.createDataFrame([(0, [1.0, 0.5]), (5, [0.25, 0.25])], schema)
    found = knn_join.top_k(two, F.col("id") == 0).collect()
    assert [tuple(r) for r in found] == [(0, 1, 5, 1024 * 256 + 512 * 256)]
    assert knn_join.top_k(two.limit(0), F.col("id") == 0).count() == 0
    assert knn_join.top_k(two, F.col("id") == 77).count() == 0
