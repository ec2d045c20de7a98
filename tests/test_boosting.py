from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from tideline.operators import boosting
from tideline.operators import explain
from tideline.operators.boosting import Boost, BoostParams, Tree, boost, mean_deviance
from tideline.session import new_path


def rows(n, seed=1):
    """Value in steps and products of the first features, which no linear model has."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    mean = np.exp(1.5 * (x[:, 0] > 0.3) + 1.0 * (x[:, 1] * x[:, 2] > 0) - 0.5)
    y = rng.gamma(2.0, mean / 2.0) * (rng.random(n) < 0.7)
    return x, y


def frame(spark, x, y, parts=3):
    data = [(v.tolist(), float(t)) for v, t in zip(x, y)]
    return spark.createDataFrame(data, "x array<double>, y double").repartition(parts)


EXACT = BoostParams(rounds=6, rate=0.3, depth=3, min_rows=5, row_share=1.0, feature_share=1.0)


def plain_boost(x, y, params):
    """Rounds by trying every split on every value; returns margins and losses."""
    p = params.variance_power
    f = np.full(len(y), math.log(y.mean()))
    losses = []

    def grow(index, depth):
        big_g, big_h = g[index].sum(), h[index].sum()
        best = (1e-9, None, None)
        if depth < params.depth:
            for i in range(x.shape[1]):
                for cut in np.unique(x[index, i])[:-1]:
                    left = x[index, i] <= cut
                    if min(left.sum(), (~left).sum()) < params.min_rows:
                        continue
                    a, b = index[left], index[~left]
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - big_g**2 / big_h
                    if gain > best[0] + 1e-9:
                        best = (gain, a, b)
        if best[1] is None:
            if depth:
                f[index] -= params.rate * big_g / big_h
        else:
            grow(best[1], depth + 1)
            grow(best[2], depth + 1)

    for _ in range(params.rounds):
        up, down = np.exp((2 - p) * f), y * np.exp((1 - p) * f)
        losses.append((up / (2 - p) - down / (1 - p)).mean())
        g, h = up - down, (2 - p) * up - (1 - p) * down
        grow(np.arange(len(y)), 0)
    return f, losses


def test_rounds_equal_a_plain_program(spark):
    x, y = rows(90)
    found = boost(frame(spark, x, y), "x", "y", EXACT)
    margins, losses = plain_boost(x, y, EXACT)
    assert found.losses == pytest.approx(losses)
    assert found.margins(x) == pytest.approx(margins)


@pytest.mark.parametrize("refresh", [2, 25])
def test_many_blocks_equal_one(spark, monkeypatch, refresh):
    x, y = rows(400)
    one = boost(frame(spark, x, y), "x", "y", EXACT)
    monkeypatch.setattr(boosting, "REFRESH", refresh)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 70)
    many = boost(frame(spark, x, y, 6), "x", "y", EXACT)
    assert many.losses == pytest.approx(one.losses)
    assert many.margins(x) == pytest.approx(one.margins(x))


def test_draws_of_rows_and_features_are_the_same_again(spark):
    x, y = rows(200)
    params = BoostParams(rounds=4, row_share=0.6, feature_share=0.5)
    table = frame(spark, x, y, 1)
    assert boost(table, "x", "y", params).to_json() == boost(table, "x", "y", params).to_json()
    assert boost(table, "x", "y", BoostParams(rounds=4, row_share=0.6, feature_share=0.5, seed=7)).to_json() != (
        boost(table, "x", "y", params).to_json()
    )


def test_better_than_a_linear_predictor_on_unseen_rows(spark):
    cells = [f"c{i}" for i in range(4)]
    named = lambda data: frame(spark, *data).selectExpr(*[f"x[{i}] AS c{i}" for i in range(4)], "y")
    train, test = named(rows(3000, 2)), named(rows(2000, 3))
    params = json.dumps({"rounds": 60, "rate": 0.1, "depth": 3})
    vector = VectorAssembler(inputCols=cells, outputCol="features")
    model = Pipeline(stages=[vector, Boost(labelCol="y", settings=params)]).fit(train)
    fitted = model.stages[-1]
    losses = fitted.fitted.losses
    assert all(b < a for a, b in zip(losses, losses[1:]))
    importance = fitted.featureImportances.toArray()
    assert importance.sum() == pytest.approx(1) and importance[3] < 0.1
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="y", predictionCol="glm")
    linear = Pipeline(stages=[vector, glm]).fit(train).transform(test)
    boosted = model.transform(test)
    assert boosted.filter("prediction <= 0").count() == 0
    assert mean_deviance(boosted, "y", "prediction", 1.5) < 0.9 * mean_deviance(linear, "y", "glm", 1.5)

    path = new_path(spark, "boosted")
    model.write().save(path)
    again = PipelineModel.load(path).transform(test)
    assert again.select("prediction").collect() == boosted.select("prediction").collect()


def test_edges(spark):
    same = boost(frame(spark, np.zeros((30, 2)), np.full(30, 2.0)), "x", "y", EXACT)
    assert [t.value for t in same.trees] == [Tree().value] * EXACT.rounds  # nothing to split
    assert np.exp(same.margins(np.ones((1, 2))))[0] == pytest.approx(2.0)
    nothing = boost(frame(spark, np.zeros((30, 2)), np.zeros(30)), "x", "y", EXACT)
    assert np.isfinite(nothing.margins(np.ones((1, 2)))).all()
    with pytest.raises(ValueError, match="no rows"):
        boost(spark.createDataFrame([], "x array<double>, y double"), "x", "y", EXACT)


@pytest.mark.parametrize("loss", ["logistic", "squared"])
def test_other_losses_with_weights_and_contributions(spark, loss):
    x, value = rows(800, 5)
    y = (value > np.median(value)).astype(float) if loss == "logistic" else value
    data = [(i, *map(float, v), float(t), 1.0 + i % 3) for i, (v, t) in enumerate(zip(x, y))]
    table = spark.createDataFrame(data, "customer_id long, c0 double, c1 double, c2 double, c3 double, y double, w double")
    vector = VectorAssembler(inputCols=[f"c{i}" for i in range(4)], outputCol="features")
    settings = json.dumps({"rounds": 30, "rate": 0.1, "depth": 3, "loss": loss})
    model = Pipeline(stages=[vector, Boost(labelCol="y", settings=settings, weight="w")]).fit(table)
    fitted = model.stages[-1].fitted
    weight = np.array([d[-1] for d in data])
    mean = np.average(y, weights=weight)
    base = math.log(mean / (1 - mean)) if loss == "logistic" else mean
    start = np.logaddexp(0, base) - y * base if loss == "logistic" else (y - base) ** 2 / 2
    assert fitted.base == pytest.approx(base)
    assert fitted.losses[0] == pytest.approx(np.average(start, weights=weight))
    assert all(b < a for a, b in zip(fitted.losses, fitted.losses[1:]))
    margins = fitted.margins(x)
    out = {r.customer_id: r for r in model.transform(table).collect()}
    for i in (0, 5, 99):
        if loss == "logistic":
            p = 1 / (1 + math.exp(-margins[i]))
            assert out[i].probability[1] == pytest.approx(p) and out[i].prediction == float(p > 0.5)
        else:
            assert out[i].prediction == pytest.approx(margins[i])
    # Contributions and the mean over the trees' own rows add up to the margin.
    mean_value = explain.base_value(explain.read_trees(model.stages[-1]))
    for r in explain.tree_shap(model, table, ["customer_id"]).collect():
        assert fitted.base + mean_value + sum(r.shap) == pytest.approx(margins[r.customer_id])


def test_rows_of_one_block_take_few_jobs(spark):
    rng = F.rand(1)
    table = spark.range(40_000, numPartitions=4).select(F.array(rng, F.rand(2)).alias("x"), F.rand(3).alias("y"))
    spark.sparkContext.setJobGroup("boost", "rounds of one block")
    try:
        found = boost(table, "x", "y", BoostParams(rounds=10, depth=4))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found.trees) == 10
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("boost")) < 15
