"""Segments, priorities, explanations, recommendations and report views."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.frames import collected, only
from tideline.operators import (
    explain,
    modelling,
    prioritisation,
    recommendations,
    segmentation,
    views,
)
from tideline.params import ActionParams, PriorityParams, SegmentationParams


@pytest.mark.parametrize("n", [6, 7, 11, 23, 96])
def test_quintiles_like_linear_cuts(spark, n):
    rng = np.random.default_rng(n)
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "recency_days": rng.integers(0, 5, n),
            "n_orders": rng.integers(1, 4, n),
            "net_revenue": np.round(rng.normal(100, 80, n), 1),
        }
    )
    got = segmentation.rfm_scores(spark.createDataFrame(pdf)).toPandas().sort_values("customer_id")
    for score, column, expect in (
        ("r_score", "recency_days", lambda q: 6 - q),
        ("f_score", "n_orders", lambda q: q + 1),
        ("m_score", "net_revenue", lambda q: q + 1),
    ):
        quintile = pd.qcut(pdf[column].rank(method="first"), 5, labels=False)
        assert got[score].tolist() == expect(quintile).tolist()


def test_rules(spark):
    n = 100
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "recency_days": np.arange(n),
            "n_orders": np.arange(n, 0, -1),
            "net_revenue": np.arange(n, 0, -1) * 10.0,
            "return_value_ratio": [0.6] + [0.1] * (n - 1),
            "tenure_days": [400] * 99 + [100],
        }
    )
    df = spark.createDataFrame(pdf)
    got = {r[0]: r[1] for r in segmentation.rfm_rule_segments(df).collect()}
    assert got[0] == "High-return customers" and got[1] == "Champions"
    assert got[99] == "New customers" and got[90] == "Occasional buyers"
    # With scores 2..6 nobody can be lost; the conventional score makes room for them.
    assert "Lost customers" not in got.values()
    usual = segmentation.rfm_rule_segments(df, SegmentationParams(recency_score_top=5))
    assert usual.filter("rule_segment = 'Lost customers'").count() > 0


def test_cluster_names(spark):
    rows = [(1, 0, "Champions"), (2, 0, "Champions"), (3, 0, "New customers"),
            (4, 1, "Champions"), (5, 2, "New customers"), (6, 2, "Loyal customers")]
    named = segmentation.name_clusters(
        spark.createDataFrame(rows, "customer_id long, cluster int, rule_segment string")
    )
    assert {r["cluster"]: r["segment_name"] for r in collected(named)} == {
        0: "Champions #0", 1: "Champions #1", 2: "Loyal customers",
    }
    crossed = {r["segment_name"]: r for r in collected(segmentation.segment_crosstab(named))}
    assert crossed["Champions #0"]["Champions"] == 2
    assert crossed["Champions #0"]["New customers"] == 1
    assert crossed["Champions #0"]["Lost customers"] == 0


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(9)
    n = 90
    centre = np.repeat([0, 8, 16], n // 3)
    pdf = pd.DataFrame({c: np.abs(rng.normal(centre + 2, 0.4)) for c in SegmentationParams().cluster_features})
    pdf["customer_id"] = np.arange(n)
    pdf.loc[3, "avg_interval"] = np.nan
    df = spark.createDataFrame(pdf)
    return df.withColumn("avg_interval", F.when(~F.isnan("avg_interval"), F.col("avg_interval")))


def test_segmentation(blobs):
    params = SegmentationParams(k_range=(2, 3), kmeans_restarts=2)
    result = segmentation.segment_customers(blobs, params)
    # A mixture that puts everyone into one cluster is left out of the candidates.
    assert result.segments.count() == 90 and 4 <= result.candidates.count() <= 6
    assert result.k == 3 and result.silhouette > 0.8
    report = only(result.report)
    scores = [c["silhouette"] for c in report["candidates"]]
    assert scores == sorted(scores, reverse=True)
    assert sum(report["cluster_sizes"].values()) == 90


@pytest.fixture(scope="module")
def value_risk(spark):
    rng = np.random.default_rng(12)
    n = 120
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "cohort_date": pd.Timestamp("2011-09-01"),
            "churn_probability": rng.random(n),
            "expected_future_clv": np.round(rng.gamma(2, 100, n), 2),
            "actual_future_revenue": np.round(rng.gamma(1, 30, n), 2),
            "recency_days": rng.integers(1, 200, n),
            "churn": rng.integers(0, 2, n),
        }
    )
    pdf["revenue_at_risk"] = pdf["churn_probability"] * pdf["expected_future_clv"]
    return pdf, spark.createDataFrame(pdf)


def _prioritised(spark, df, budgets=(10, 25)):
    risk = df.drop("recency_days", "churn")
    test = df.select("customer_id", "cohort_date", "recency_days", "churn")
    segments = spark.createDataFrame(
        [(i, "ABC"[i % 3]) for i in range(100)], "customer_id long, segment_name string"
    )
    return prioritisation.retention_priorities(risk, test, segments, PriorityParams(budgets=budgets))


def test_priorities(spark, value_risk):
    pdf, df = value_risk
    got = _prioritised(spark, df).toPandas().sort_values("priority_rank")
    assert got["priority_rank"].tolist() == list(range(1, 121))
    assert got["customer_id"].tolist() == pdf.sort_values("revenue_at_risk", ascending=False)["customer_id"].tolist()
    assert got["target_top_10"].sum() == 10 and got["target_top_25"].sum() == 25
    assert (got.loc[got["customer_id"] >= 100, "segment_name"] == "Unknown").all()


def test_risk_level_edges(spark):
    values = [0.0, 0.34, 0.3400001, 0.67, 0.6700001, 1.0, None, 1.1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
    rows = collected(df.select("i", prioritisation.risk_level(F.col("p")).alias("l")), "i")
    assert [r["l"] for r in rows] == [
        "Low", "Low", "Medium", "Medium", "High", "High", None, None,
    ]


def test_strategies(spark, value_risk):
    pdf, df = value_risk
    params = PriorityParams(budgets=(10, 500))
    ranked = _prioritised(spark, df)
    rows = collected(prioritisation.compare_strategies(ranked, params))
    by_key = {(r["strategy"], r["budget"]): r for r in rows}
    assert len(by_key) == 8
    largest = pdf["revenue_at_risk"].nlargest(10).sum()
    assert by_key["revenue_at_risk", 10]["revenue_at_risk_captured"] == pytest.approx(largest, abs=0.01)
    assert by_key["churn_probability", 500]["n_targeted"] == 120
    recent = pdf.sort_values(["recency_days", "customer_id"], ascending=[False, True]).head(10)
    naive = by_key["recency_rule", 10]
    assert naive["actual_churners_captured"] == recent["churn"].sum()
    threshold = pdf["expected_future_clv"].quantile(0.75)
    assert naive["high_value_customers_captured"] == (recent["expected_future_clv"] >= threshold).sum()
    report = only(prioritisation.prioritisation_report(ranked, params))
    headline = report["headline"]
    assert headline["at_budget"] == 10
    assert headline["absolute_uplift"] == pytest.approx(
        largest - recent["revenue_at_risk"].sum(), abs=0.02
    )
    assert report["totals"]["total_high_value_customers"] == (pdf["expected_future_clv"] >= threshold).sum()
    curve = {(r["strategy"], r["fraction"]): r["revenue_at_risk_captured"] for r in report["capture_curves"]}
    assert curve["expected_clv", 1.0] == pytest.approx(pdf["revenue_at_risk"].sum(), abs=0.01)
    lapsed = pdf[pdf["recency_days"] > 90]
    assert report["recency_rule_full"]["n_targeted"] == len(lapsed)


def test_uplift_without_base(spark):
    rows = [("revenue_at_risk", 10, 5.0), ("recency_rule", 10, 0.0)]
    df = spark.createDataFrame(rows, "strategy string, budget int, revenue_at_risk_captured double")
    got = only(prioritisation.headline_uplift(df))
    assert got["absolute_uplift"] == 5.0 and got["relative_uplift"] is None


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(21)
    n = 160
    pdf = pd.DataFrame(
        {
            "customer_id": np.arange(n),
            "cohort_date": pd.Timestamp("2011-09-01"),
            "a": rng.normal(0, 1, n),
            "b": rng.integers(0, 6, n).astype(float),
            "c": rng.normal(5, 2, n),
            "country_grouped": rng.choice(["France", "Other"], n),
        }
    )
    pdf["churn"] = ((pdf["a"] + 0.3 * pdf["b"] + (pdf["country_grouped"] == "France") + rng.normal(0, 0.5, n)) > 1).astype(int)
    columns = modelling.FeatureColumns(("a", "b", "c"), ("country_grouped",))
    return spark.createDataFrame(pdf), columns


def _fit(panel, estimator):
    df, columns = panel
    return modelling.fit_pipeline(columns, df, estimator, scale=False)


def _brute_force(trees, row):
    """Shapley values over all coalitions, absent features averaged by cover."""
    size = len(row)

    def below(tree, node, present):
        if tree.left[node] < 0:
            return tree.value[node]
        total = 0.0
        for child in (tree.left[node], tree.right[node]):
            inside = tree.above[child] < row[tree.feature[node]] <= tree.upto[child]
            weight = float(inside) if tree.feature[node] in present else tree.share[child]
            if weight:
                total += weight * below(tree, child, present)
        return total

    def payoff(present):
        return sum(below(tree, 0, present) for tree in trees)

    result = np.zeros(size)
    for j in range(size):
        others = [k for k in range(size) if k != j]
        for count in range(size):
            factor = math.factorial(count) * math.factorial(size - count - 1) / math.factorial(size)
            for chosen in itertools.combinations(others, count):
                result[j] += factor * (payoff({*chosen, j}) - payoff(set(chosen)))
    return result


def test_forest_contributions(panel):
    df, columns = panel
    model = _fit(panel, RandomForestClassifier(labelCol="churn", numTrees=5, maxDepth=6, seed=3))
    leaves = explain.read_trees(modelling.fitted_model(model))
    rows = model.transform(df).select(
        vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p"),
        "customer_id",
    ).orderBy("customer_id").toPandas()
    shap = {r["customer_id"]: r["shap"] for r in explain.tree_shap(model, df).collect()}
    for _, row in rows.iterrows():
        total = explain.base_value(leaves) + sum(shap[row["customer_id"]])
        assert total == pytest.approx(row["p"], abs=1e-9)
    for _, row in rows.head(5).iterrows():
        expected = _brute_force(leaves, row["x"])
        assert np.allclose(shap[row["customer_id"]], expected, atol=1e-9)


def test_boosted_contributions(panel):
    df, _ = panel
    model = _fit(panel, GBTClassifier(labelCol="churn", maxIter=4, maxDepth=3, seed=3))
    leaves = explain.read_trees(modelling.fitted_model(model))
    margins = {
        r["customer_id"]: r["p"]
        for r in model.transform(df)
        .select("customer_id", vector_to_array("probability")[1].alias("p")).collect()
    }
    for row in explain.tree_shap(model, df).collect():
        margin = explain.base_value(leaves) + sum(row["shap"])
        assert 1 / (1 + math.exp(-2 * margin)) == pytest.approx(margins[row["customer_id"]], abs=1e-9)


def test_linear_contributions(panel):
    df, _ = panel
    model = _fit(panel, LogisticRegression(labelCol="churn"))
    fitted = modelling.fitted_model(model)
    rows = model.transform(df).select("customer_id", vector_to_array("features").alias("x")).toPandas()
    centre = np.stack(rows["x"]).mean(axis=0)
    shap = {r["customer_id"]: r["shap"] for r in explain.tree_shap(model, df).collect()}
    for _, row in rows.head(10).iterrows():
        expected = fitted.coefficients.toArray() * (row["x"] - centre)
        assert np.allclose(shap[row["customer_id"]], expected)


def test_factor_tables(spark):
    names = ["x", "y", "z"]
    shap = spark.createDataFrame(
        [(1, [0.5, -0.7, 0.1]), (2, [-0.5, 0.7, 0.0]), (3, [0.2, 0.2, -0.2])],
        "customer_id long, shap array<double>",
    )
    factors = collected(explain.customer_top_factors(shap, names), "customer_id", "rank")
    assert [f["feature"] for f in factors[:3]] == ["y", "x", "z"]
    assert factors[0]["direction"] == "decreases_risk" and factors[0]["abs_shap"] == 0.7
    # Equal strengths go by name.
    assert [f["feature"] for f in factors[6:]] == ["x", "y", "z"]
    overall = collected(explain.global_importance(shap, names), "rank")
    assert overall[0]["feature"] == "y" and overall[0]["mean_abs_shap"] == pytest.approx(1.6 / 3)
    segments = spark.createDataFrame(
        [(1, "A"), (2, "A"), (3, "B")], "customer_id long, segment_name string"
    )
    parts = collected(explain.segment_factors(shap, names, segments), "segment_name", "rank")
    first = {r["feature"]: r for r in parts if r["segment_name"] == "A"}
    assert first["y"]["abs_mean_shap"] == pytest.approx(0.0)
    assert first["y"]["mean_abs_shap"] == pytest.approx(0.7)


def test_importance(panel):
    _, columns = panel
    model = _fit(panel, RandomForestClassifier(labelCol="churn", numTrees=5, maxDepth=4, seed=3))
    rows = collected(modelling.feature_importance(columns, model, "forest"))
    assert {r["feature"] for r in rows} == {
        "a", "b", "c", "country_grouped_France", "country_grouped_Other",
    }
    values = [r["importance"] for r in rows]
    assert values == sorted(values, reverse=True) and sum(values) == pytest.approx(1)


PRIORITIES = [
    (1, "Champions", "High", 1, 0.9, 500.0, 450.0),
    (2, "Champions", "Low", 2, 0.2, 500.0, 100.0),
    (3, "Unknown", "Low", 3, 0.1, 100.0, 10.0),
    (4, "New customers #2", "Low", 4, 0.1, 50.0, 5.0),
]
SCHEMA = (
    "customer_id long, segment_name string, risk_level string, priority_rank long, "
    "churn_probability double, expected_future_clv double, revenue_at_risk double"
)


def _recommended(spark, params=ActionParams()):
    priorities = spark.createDataFrame(PRIORITIES, SCHEMA)
    factors = spark.createDataFrame(
        [(1, 1, "recency_days", "increases_risk"), (1, 2, "n_orders", "increases_risk"),
         (2, 1, "no_such_feature", "decreases_risk")],
        "customer_id long, rank int, feature string, direction string",
    )
    return recommendations.recommendation_table(priorities, factors, params)


def test_recommendations(spark):
    rows = collected(_recommended(spark), "customer_id")
    assert rows[0]["primary_action"] == "Win-back outreach with a personalised offer."
    assert rows[0]["rationale"] == "dominant risk factor: recency_days"
    assert rows[1]["rationale"] == "segment: Champions"
    assert rows[2]["rationale"] == rows[3]["rationale"] == "no specific signal"
    assert rows[2]["dominant_direction"] == "unknown"
    empty = ActionParams(by_factor={"recency_days": ""})
    assert collected(_recommended(spark, empty), "customer_id")[0]["rationale"] == "segment: Champions"


def test_action_tables(spark):
    found = _recommended(spark)
    summary = collected(recommendations.action_summary(found))
    assert [r["n_customers"] for r in summary] == [1, 1, 2]
    report = only(recommendations.recommendations_report(found))
    assert report["n_customers"] == 4 and len(report["actions"]) == 3
    last = report["actions"][-1]
    assert last["total_revenue_at_risk"] == 15.0
    assert [s["segment"] for s in last["top_segments"]] == ["New customers #2", "Unknown"]
    listed = collected(views.action_list(found), "total_revenue_at_risk")
    assert listed[0]["top_segments"] == "New customers #2 (1), Unknown (1)"


def test_views(spark):
    found = _recommended(spark)
    kpis = only(views.exec_kpis(found))
    assert kpis["total_customers"] == 4 and kpis["customers_at_risk"] == 1
    assert kpis["clv_at_risk"] == 500.0 and kpis["high_value_at_risk"] == 1
    levels = collected(views.risk_distribution(found), "position")
    assert [(r["risk_level"], r["n_customers"]) for r in levels] == [
        ("Low", 3), ("Medium", 0), ("High", 1),
    ]
    assert [r["customer_id"] for r in collected(views.top_customers(found, 2))] == [1, 2]
    searched = views.customer_search(found, ["Low"], ["Champions", "Unknown"], "3")
    assert [r["customer_id"] for r in collected(searched)] == [3]
    by_segment = collected(views.risk_by_segment(found))
    assert by_segment[0] == {"segment_name": "Champions", "revenue_at_risk": 550.0}
    mix = collected(views.priority_mix(found, 3))
    assert [r["segment_name"] for r in mix] == ["Champions", "Unknown"]


def test_contributions_in_groups_of_trees(panel, monkeypatch):
    df, _ = panel
    model = _fit(panel, RandomForestClassifier(labelCol="churn", numTrees=5, maxDepth=4, seed=3))
    whole = {r["customer_id"]: r["shap"] for r in explain.tree_shap(model, df).collect()}
    monkeypatch.setattr(explain, "GROUP_NODES", 40)
    assert len(list(explain.tree_groups(modelling.fitted_model(model)))) > 1
    for row in explain.tree_shap(model, df).collect():
        assert np.allclose(row["shap"], whole[row["customer_id"]], atol=1e-12)
    assert explain._groups([(0, 30), (1, 10), (2, 1), (3, 90), (4, 5)]) == [(0, 1), (2, 2), (3, 3), (4, 4)]
