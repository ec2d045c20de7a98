from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tideline.operators import explain, forest
from tideline.operators.forest import Forest, Growth
from tideline.session import new_path


def table(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) / 2 > 0).astype(int)
    rows = [(*map(float, v), int(t), float(1 + t), float(v[0] * 3 + v[3])) for v, t in zip(x, y)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double, y int, w double, z double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(frame)


def classifier(**more):
    settings = {"numTrees": 6, "maxDepth": 6, "minInstancesPerNode": 3, "seed": 5} | more
    return RandomForestClassifier(labelCol="y", weightCol="w", featureSubsetStrategy="sqrt", **settings)


def jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_depth_does_not_add_jobs(spark):
    """A fit has as many jobs at any depth: trees are not grown level by level over the cluster."""
    rows = table(spark)
    flat, deep = (jobs(spark, f"depth {d}", lambda d=d: Forest(classifier(maxDepth=d)).fit(rows)) for d in (2, 8))
    assert flat == deep


def test_splits_are_the_best_ones():
    rng = np.random.default_rng(1)
    bins, at = rng.integers(0, 5, (3, 60)), rng.integers(0, 2, 60)
    n, w, y = rng.integers(1, 4, 60).astype(float), rng.random(60) + 0.5, rng.random(60)
    w = w * n
    widths = np.array([5, 5, 5])
    gain, feature, cut = forest._best_splits(at, bins, widths, None, [n, w * y, w], 2, 4)

    def squares(rows):
        return (w * y)[rows].sum() ** 2 / w[rows].sum()

    for node in range(2):
        tried = {}
        for f in range(3):
            for c in range(4):
                left, right = (at == node) & (bins[f] <= c), (at == node) & (bins[f] > c)
                if n[left].sum() >= 4 and n[right].sum() >= 4:
                    tried[f, c] = squares(left) + squares(right) - squares(at == node)
        assert tried[feature[node], cut[node]] == pytest.approx(max(tried.values()))
        assert gain[node] == pytest.approx(max(tried.values()))


def test_only_drawn_features_are_looked_at():
    rng = np.random.default_rng(2)
    bins, at = rng.integers(0, 4, (5, 80)), rng.integers(0, 3, 80)
    chosen = np.array([[0, 1], [4, 2], [3, 1]])
    n, y = np.ones(80), rng.random(80)
    _, feature, _ = forest._best_splits(at, bins, np.full(5, 4), chosen, [n, y], 3, 1)
    assert all(f in own for f, own in zip(feature, chosen))


def test_borders_lie_midway():
    assert forest.borders(np.array([1.0, 3.0, 3.0, 7.0]), np.ones(4), 32).tolist() == [2.0, 5.0]
    assert forest.borders(np.full(5, 2.0), np.ones(5), 32).tolist() == []
    found = forest.borders(np.arange(100.0), np.ones(100), 4)
    assert found.tolist() == [24.5, 49.5, 74.5]
    # A value that most rows share has a border on its free side.
    mixed = forest.borders(np.concatenate([np.zeros(900), np.arange(1.0, 101)]), np.ones(1000), 4)
    assert len(mixed) and (mixed > 0).all()


def test_leaves_hold_their_rows(spark):
    """Weights of the classes, counts and predictions of a tree are those of the rows it was grown on."""
    rng = np.random.default_rng(4)
    bins, y, w = rng.integers(0, 6, (3, 300)), rng.integers(0, 2, 300).astype(float), rng.random(300)
    how = Growth(True, 5, 2, 0.0, 3, 9)
    tree = forest.grow(bins, np.full(3, 6), y, w, 7, how)
    counts = np.random.default_rng([9, 7]).poisson(1.0, 300)
    node = np.zeros(300, dtype=int)
    for _ in range(5):
        inner = tree.left[node] >= 0
        right = bins[np.maximum(tree.feature[node], 0), np.arange(300)] > tree.cut[node]
        node = np.where(inner, tree.left[node] + right, node)
    for leaf in np.flatnonzero(tree.left < 0):
        mine = node == leaf
        assert tree.n[leaf] == counts[mine].sum() >= 2
        assert tree.stats[leaf] == pytest.approx([(counts * w * (y == c))[mine].sum() for c in (0, 1)])


@pytest.mark.parametrize("kind", ["classes", "values"])
def test_model_is_that_of_mllib(spark, kind):
    """Scores by MLlib are the means over the stored trees; the model is stored and read back."""
    rows = table(spark)
    inner = classifier() if kind == "classes" else RandomForestRegressor(labelCol="z", numTrees=6, maxDepth=6, seed=5)
    model = Pipeline(stages=[Forest(inner)]).fit(rows)
    trees = explain.read_trees(model.stages[-1])
    assert len(trees) == model.stages[-1].getNumTrees == 6 and model.stages[-1].numFeatures == 4
    assert sum(model.stages[-1].featureImportances.toArray()) == pytest.approx(1.0)

    shown = vector_to_array("probability")[1] if kind == "classes" else F.col("prediction")
    path = new_path(spark, "model")
    model.write().overwrite().save(path)
    again = PipelineModel.load(path)
    score = lambda m: [tuple(r) for r in m.transform(rows).select("a", shown.alias("p")).collect()]
    assert score(model) == score(again)
    truth, said = zip(*[tuple(r) for r in model.transform(rows).select("y" if kind == "classes" else "z", shown).collect()])
    # Better than the mean of all rows by far.
    assert np.mean((np.array(truth) - said) ** 2) < 0.6 * np.var(truth)


def test_order_of_rows_does_not_matter(spark):
    rows = table(spark)
    one, two = (Forest(classifier()).fit(r) for r in (rows, rows.repartition(5, "a").sortWithinPartitions("d")))
    assert one.toDebugString == two.toDebugString.replace(two.uid, one.uid)


def test_other_fits_are_left_to_mllib(spark, monkeypatch):
    """More rows than a block, or labels of one class only."""
    rows = table(spark)
    calls = []
    monkeypatch.setattr(forest, "_loaded", lambda *a: calls.append(a))
    assert isinstance(Forest(classifier()).fit(rows.withColumn("y", F.col("y") + F.col("y"))), RandomForestClassificationModel)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 100)
    assert isinstance(Forest(classifier()).fit(rows), RandomForestClassificationModel)
    assert not calls
