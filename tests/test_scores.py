"""Metrics, survival analysis and value formulas against direct computations."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.frames import collected, only
from tideline.functions import metrics
from tideline.operators import churn, exploration, survival, value
from tideline.params import SurvivalParams, ValueParams


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    n = 400
    prob = np.round(rng.random(n), 1)
    prob[:6] = [0.3, 0.6, 0.7, 0.30000000000000004, 0.6000000000000001, 0.7000000000000001]
    label = (rng.random(n) < prob).astype(int)
    pdf = pd.DataFrame({"customer_id": np.arange(n), "m": "x", "y": label, "p": prob})
    return pdf, spark.createDataFrame(pdf)


def test_classification_metrics(scored):
    pdf, df = scored
    got = only(metrics.classification_metrics(df, "y", "p", ["m"], 0.6))
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()
    pairs = [(a, b) for a in p[y == 1] for b in p[y == 0]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a, b in pairs])
    precision_sum, previous = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        flagged = p >= t
        recall = y[flagged].sum() / y.sum()
        precision_sum += (recall - previous) * y[flagged].mean()
        previous = recall
    bins = np.digitize(p, np.linspace(0, 1, 11)[1:-1])
    ece = sum(
        (bins == b).mean() * abs(y[bins == b].mean() - p[bins == b].mean()) for b in set(bins)
    )
    clipped = np.clip(p, 1e-6, 1 - 1e-6)
    loss = -np.mean(y * np.log(clipped) + (1 - y) * np.log(1 - clipped))
    assert got["roc_auc"] == pytest.approx(auc, abs=1e-4)
    assert got["pr_auc"] == pytest.approx(precision_sum, abs=1e-4)
    assert got["expected_calibration_error"] == pytest.approx(ece, abs=1e-4)
    assert got["brier"] == pytest.approx(np.mean((p - y) ** 2), abs=1e-4)
    assert got["log_loss"] == pytest.approx(loss, abs=1e-4)
    assert got["true_positives"] == int(((p >= 0.6) & (y == 1)).sum())


def test_best_threshold(scored):
    pdf, df = scored
    y, p = pdf["y"].to_numpy(), pdf["p"].to_numpy()

    def f1(t):
        flagged = p >= t
        return 2 * (flagged & (y == 1)).sum() / (flagged.sum() + y.sum())

    values = [f1(t) for t in metrics.F1_THRESHOLDS]
    got = only(metrics.best_f1_threshold(df, "y", "p"))
    assert got["threshold"] == metrics.F1_THRESHOLDS[int(np.argmax(values))]
    assert got["f1"] == pytest.approx(max(values))


def test_degenerate_scores(spark):
    df = spark.createDataFrame([(1, "x", 0, 0.2), (2, "x", 0, 0.1)], "customer_id long, m string, y int, p double")
    got = only(metrics.classification_metrics(df, "y", "p", ["m"]))
    assert got["precision"] == got["recall"] == got["f1"] == 0.0 and got["roc_auc"] is None


def test_top_fraction(scored):
    pdf, df = scored
    got = collected(metrics.top_fraction_capture(df, "y", "p", "customer_id", [0.1, 0.001]), "fraction")
    top = pdf.sort_values(["p", "customer_id"], ascending=[False, True])
    assert got[0]["n_selected"] == 1 and got[1]["n_selected"] == 40
    assert got[1]["n_captured"] == top["y"].head(40).sum()
    assert got[1]["lift"] == pytest.approx(top["y"].head(40).mean() / pdf["y"].mean(), abs=1e-4)


def test_regression_metrics(spark):
    rng = np.random.default_rng(2)
    actual = np.where(rng.random(300) < 0.6, 0.0, np.round(rng.gamma(2, 50, 300), 1))
    predicted = np.round(actual * 0.4 + rng.normal(20, 15, 300), 0)
    pdf = pd.DataFrame({"customer_id": range(300), "m": "x", "a": actual, "p": predicted})
    got = only(metrics.regression_metrics(spark.createDataFrame(pdf), "a", "p", "customer_id", ["m"]))
    error = actual - predicted
    assert got["mae"] == pytest.approx(np.abs(error).mean(), abs=1e-4)
    assert got["rmse"] == pytest.approx(np.sqrt((error**2).mean()), abs=1e-4)
    assert got["r2"] == pytest.approx(1 - (error**2).sum() / ((actual - actual.mean()) ** 2).sum(), abs=1e-4)
    spearman = pdf["a"].rank().corr(pdf["p"].rank())
    assert got["spearman"] == pytest.approx(spearman, abs=1e-4)
    top = pdf.sort_values(["p", "customer_id"], ascending=[False, True]).head(30)
    assert got["top_decile_value_capture"] == pytest.approx(top["a"].sum() / actual.sum(), abs=1e-4)


def test_calibration_methods(scored):
    _, df = scored
    validation = df.select(F.col("p").alias(churn.RAW), F.col("y").alias("y_true"))
    for method in ("isotonic", "sigmoid"):
        applied = churn.calibrator(validation, method)(validation)
        rows = applied.select(churn.RAW, churn.CALIBRATED).distinct().orderBy(churn.RAW).collect()
        values = [r[1] for r in rows]
        assert all(0 <= v <= 1 for v in values)
        assert all(b >= a - 1e-9 for a, b in zip(values, values[1:]))
        gate = only(churn.calibration_gate(applied, "y_true", churn.RAW, churn.CALIBRATED))
        assert gate["calibration_applied"] == (gate["brier_calibrated"] < gate["brier_raw"])


def test_value_formulas(spark):
    df = spark.createDataFrame(
        [(1, 0.25, 100.0), (2, 0.99, 50.0), (3, 0.0, 10.0)],
        "customer_id long, churn_probability double, predicted_90d_value double",
    )
    rows = collected(value.value_formulas(df), "customer_id")
    ratio = 0.75
    clv = 100 / 0.75 * (1 - ratio ** (365 / 90)) / (1 - ratio)
    assert rows[0]["expected_future_clv"] == pytest.approx(clv)
    assert rows[0]["revenue_at_risk"] == pytest.approx(0.25 * clv)
    assert rows[1]["retention_probability"] == 0.1 and rows[2]["retention_probability"] == 0.999
    for row in rows:
        assert row["revenue_at_risk"] == pytest.approx(
            row["churn_probability"] * row["expected_future_clv"], rel=1e-9
        )
    discounted = collected(
        value.value_formulas(df, ValueParams(discount_rate_annual=0.1)), "customer_id"
    )
    assert discounted[0]["expected_future_clv"] < rows[0]["expected_future_clv"]


def test_largest_share(spark):
    values = [5.0] * 7 + [9.0, 1.0, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = only(value.largest_share(df, "v", 0.3))
    assert got["n_rows"] == 10 and got["top_total"] == 19.0
    assert got["top_share"] == pytest.approx(19 / 46)


@pytest.fixture(scope="module")
def lifetimes(spark):
    rng = np.random.default_rng(4)
    n = 150
    x1, x2 = rng.normal(0, 1, n), rng.normal(3, 2, n)
    time = np.maximum(1, np.round(rng.exponential(12 * np.exp(-0.7 * x1))))
    event = (rng.random(n) < 0.7).astype(int)
    segment = np.where(rng.random(n) < 0.2, None, rng.choice(["A", "B"], n))
    pdf = pd.DataFrame(
        {"customer_id": range(n), "x1": x1, "x2": x2, "duration": time.astype(int),
         "event": event, "segment_name": segment}
    )
    return pdf, spark.createDataFrame(pdf)


def test_kaplan_meier(lifetimes):
    pdf, df = lifetimes
    curves = survival.kaplan_meier(df)
    got = curves.toPandas()
    for name, part in [("Overall", pdf), *pdf.groupby("segment_name")]:
        level, expected = 1.0, {0.0: 1.0}
        for t in sorted(part["duration"].unique()):
            at_risk = (part["duration"] >= t).sum()
            died = part.loc[part["duration"] == t, "event"].sum()
            level *= 1 - died / at_risk
            expected[float(t)] = level
        mine = got[got["segment"] == name].set_index("time_days")["survival"]
        assert len(mine) == len(expected)
        assert all(mine[t] == pytest.approx(s, abs=1e-9) for t, s in expected.items())
        median = min((t for t, s in expected.items() if s <= 0.5), default=math.inf)
        found = curves.filter(F.col("segment") == name)
        assert only(survival.median_survival(found))["median_survival_days"] == median


def _efron(beta, x, time, event, strength):
    total = -0.5 * strength * beta @ beta
    w = np.exp(x @ beta)
    for t in np.unique(time[event == 1]):
        died = (time == t) & (event == 1)
        d, risk, tied = died.sum(), w[time >= t].sum(), w[died].sum()
        total += (x[died] @ beta).sum() - sum(np.log(risk - k / d * tied) for k in range(d))
    return total


def test_cox(lifetimes):
    pdf, df = lifetimes
    fit = survival.cox_ph(df, SurvivalParams(features=("x1", "x2")))
    x = pdf[["x1", "x2"]].to_numpy()
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    time, event = pdf["duration"].to_numpy(), pdf["event"].to_numpy()
    strength = 0.1 * len(pdf)
    beta = fit.coefficients * fit.deviations
    best = _efron(beta, z, time, event, strength)
    assert fit.log_likelihood == pytest.approx(best, rel=1e-9)
    assert np.abs(fit.gradient).max() < 1e-4
    for step in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert _efron(beta + np.array(step), z, time, event, strength) <= best + 1e-9
    assert fit.coefficients[0] > 0
    for row in fit.summary():
        assert row["exp_coef_lower_95"] < row["exp_coef"] < row["exp_coef_upper_95"]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 23, 24, 25, 100, 5_000, 1_000_000])
@pytest.mark.parametrize("ratio", [1.0, 1.5, 40.0, 1e4, 1e7])
def test_tie_sums_equal_the_plain_sums(d, ratio):
    e0 = 0.3 * d
    s0 = e0 * ratio
    a = np.arange(d) / d
    r = s0 - a * e0
    found = survival._tie_sums(d, s0, e0)
    plain = [np.log(r), 1 / r, a / r, 1 / r**2, a / r**2, a**2 / r**2]
    # As they enter the derivatives: times the sums of the events, beside a whole of about d.
    scale = [1.0, s0, e0, s0**2, s0 * e0, e0**2]
    for value, terms, by in zip(found, plain, scale):
        assert value * by == pytest.approx(math.fsum(terms) * by, rel=1e-9, abs=1e-9 * d)


def test_counts_beyond_a_long(spark):
    """Products of counts of some billions, as cells and pairs have them."""
    many = 5_000_000_000
    cells = spark.createDataFrame(
        [("a", "x", many), ("a", "y", 2 * many), ("b", "x", 3 * many), ("b", "y", 4 * many)],
        "r string, c string, _o long",
    )
    found = only(exploration._chi_square_of_cells(cells, "r", "c"))
    n = 10 * many
    plain = n * (
        many**2 / (3 * many * 4 * many) + 4 / (3 * 6) + 9 / (7 * 4) + 16 / (7 * 6) - 1
    )
    assert found["n"] == n and found["chi2"] == pytest.approx(plain, rel=1e-6)
    lives = spark.createDataFrame(
        [(1, many, many, 0), (2, many, 0, 1)], "duration long, n long, events long, place long"
    )
    assert lives.agg(survival.pair_sum(F.col("n"), F.col("events"))).first()[0] == many * many


def test_concordance(lifetimes):
    pdf, df = lifetimes
    pdf = pdf.assign(risk=np.round(pdf["x1"], 1))
    rows = pdf[["duration", "event", "risk"]].to_numpy()
    good = bad = tied = 0
    for a, b in itertools.permutations(rows, 2):
        if a[1] == 1 and (b[0] > a[0] or (b[0] == a[0] and b[1] == 0)):
            good += a[2] > b[2]
            bad += a[2] < b[2]
            tied += a[2] == b[2]
    scored = df.withColumn("risk", F.round("x1", 1))
    got = only(survival.concordance(scored, "duration", "event", "risk"))
    found = tuple(int(got[c]) for c in ("concordant", "discordant", "tied_risk"))
    assert found == (good, bad, tied)
    assert got["concordance_index"] == pytest.approx((good + tied / 2) / (good + bad + tied))
    assert got["concordance_index"] > 0.5


def test_survival_report(lifetimes):
    _, df = lifetimes
    fit = survival.cox_ph(df, SurvivalParams(features=("x1", "x2")))
    report = only(survival.survival_report(df, survival.kaplan_meier(df), fit, 0.7))
    assert report["n_customers"] == 150 and report["segments"] == ["A", "B"]
    assert [h["covariate"] for h in report["cox_hazard_ratios"]] == ["x1", "x2"]


def test_survival_input(spark):
    features = spark.createDataFrame(
        [(1, 100, 30), (2, 100, 100), (3, 0, 0)], "customer_id long, tenure_days int, recency_days int"
    )
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0)], "customer_id long, churn int")
    segments = spark.createDataFrame([(1, "A")], "customer_id long, segment_name string")
    rows = collected(survival.survival_input(features, labels, segments), "customer_id")
    assert [r["duration"] for r in rows] == [70, 1, 1]
    assert [r["segment_name"] for r in rows] == ["A", None, None]


def test_chi_square_tail():
    assert exploration.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert exploration.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05, abs=1e-9)
    assert exploration.chi_square_tail(36.41502850180731, 24) == pytest.approx(0.05, abs=1e-9)


def test_chi_square_two_by_two(spark):
    rows = [("a", True)] * 12 + [("a", False)] * 5 + [("b", True)] * 6 + [("b", False)] * 9
    got = only(exploration.chi_square_assoc(spark.createDataFrame(rows, "r string, c boolean"), "r", "c"))
    table = np.array([[12, 5], [6, 9]], float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    corrected = ((np.abs(table - expected) - 0.5) ** 2 / expected).sum()
    assert got["dof"] == 1 and got["chi2"] == pytest.approx(corrected)
    assert got["p_value"] == pytest.approx(exploration.chi_square_tail(corrected, 1))


def test_mann_whitney(spark):
    rng = np.random.default_rng(6)
    rows = [(bool(rng.random() < 0.3), float(rng.integers(0, 20))) for _ in range(200)]
    got = only(
        exploration.mann_whitney(spark.createDataFrame(rows, "f boolean, v double"), "v", F.col("f"))
    )
    first = [v for f, v in rows if f]
    second = [v for f, v in rows if not f]
    u = sum((a > b) + 0.5 * (a == b) for a in first for b in second)
    assert got["u_statistic"] == u and 0 < got["p_value"] <= 1
