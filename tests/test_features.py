"""Feature store, labels and panel against a plain pandas computation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.frames import CURATED_SCHEMA, collected, curated_frame, curated_rows, random_lines
from tideline.operators import baseline, features
from tideline.params import TemporalParams

TEMPORAL = TemporalParams(cutoff_date="2011-01-15")
COLUMNS = [c.split()[0] for c in CURATED_SCHEMA.split(", ")]


def expected_features(lines: pd.DataFrame, cutoff: pd.Timestamp) -> pd.DataFrame:
    """The definitions written out customer by customer."""
    seen = lines[lines["invoice_date"] <= cutoff]
    result = []
    for customer, mine in seen.groupby("customer_id"):
        bought = mine[~mine["is_cancellation"]]
        if bought.empty:
            continue
        orders = (
            bought.groupby("invoice_no")
            .agg(date=("invoice_date", "min"), value=("line_revenue", "sum"), n=("quantity", "size"))
            .reset_index()
            .sort_values(["date", "invoice_no"])
        )
        gaps = [
            math.floor((b - a) / pd.Timedelta(days=1))
            for a, b in zip(orders["date"], orders["date"][1:])
        ]
        half = len(gaps) // 2
        days = (orders["date"] - orders["date"].min()) / pd.Timedelta(days=1)
        returned = mine[mine["is_cancellation"]]
        age = (cutoff - orders["date"]) / pd.Timedelta(days=1)
        modes = bought["country_grouped"].value_counts()
        result.append(
            {
                "customer_id": customer,
                "n_orders": len(orders),
                "gross_revenue": orders["value"].sum(),
                "median_order_value": orders["value"].median(),
                "std_order_value": orders["value"].std() if len(orders) > 1 else 0.0,
                "avg_basket_lines": orders["n"].mean(),
                "avg_interval": np.mean(gaps) if gaps else None,
                "std_interval": np.std(gaps, ddof=1) if len(gaps) > 1 else 0.0,
                "days_since_previous_purchase": gaps[-1] if gaps else None,
                "interval_change": np.mean(gaps[half:]) - np.mean(gaps[:half])
                if len(gaps) > 1 else 0.0,
                "n_orders_30": int((age < 30).sum()),
                "n_orders_90": int((age < 90).sum()),
                "revenue_180": orders["value"][age < 180].sum(),
                "revenue_prev_90": orders["value"][(age >= 90) & (age < 180)].sum(),
                "n_unique_products": bought["stock_code"].nunique(),
                "n_cancel_orders": returned["invoice_no"].nunique(),
                "return_value": returned["return_value"].sum(),
                "active_months": bought["invoice_month"].nunique(),
                "country_grouped": sorted(modes[modes == modes.max()].index)[0],
                "revenue_trend_slope": np.polyfit(days, orders["value"], 1)[0]
                if len(orders) > 1 and days.max() > 0 else 0.0,
                "recency_days": math.floor(age.min()),
                "tenure_days": math.floor(age.max()),
            }
        )
    return pd.DataFrame(result)


def assert_same(got: pd.DataFrame, expected: pd.DataFrame) -> None:
    assert set(got["customer_id"]) == set(expected["customer_id"])
    joined = got.merge(expected, on="customer_id", suffixes=("", "_x"))
    for column in expected.columns.drop("customer_id"):
        left, right = joined[column], joined[f"{column}_x"]
        if column == "country_grouped":
            assert (left == right).all()
        else:
            same = np.isclose(left.astype(float), right.astype(float), atol=1e-6, equal_nan=True)
            assert same.all(), (column, joined[~same][["customer_id", column, f"{column}_x"]])


@pytest.fixture(scope="module")
def lines():
    return pd.DataFrame(curated_rows(random_lines(3)), columns=COLUMNS)


@pytest.fixture(scope="module")
def curated(spark, lines):
    return spark.createDataFrame(lines, CURATED_SCHEMA)


def test_features_match_plain_computation(curated, lines):
    got = features.customer_features(curated, TEMPORAL)
    assert len(got.columns) == 51
    assert_same(got.toPandas(), expected_features(lines, pd.Timestamp("2011-01-15")))


def test_panel_equals_single_cutoffs(curated, lines):
    """Windows of different cohorts overlap and invoices straddle cutoffs."""
    dates = ["2010-06-01", "2010-08-15", "2010-09-01"]
    panel = features.cohort_panel(curated, dates, TEMPORAL).toPandas()
    for date in dates:
        cutoff = pd.Timestamp(date)
        part = panel[panel["cohort_date"] == cutoff]
        assert_same(part, expected_features(lines, cutoff))
        ahead = lines[
            (lines["invoice_date"] > cutoff)
            & (lines["invoice_date"] <= cutoff + pd.Timedelta(days=90))
            & ~lines["is_cancellation"]
        ]
        orders = ahead.groupby("customer_id")["invoice_no"].nunique()
        money = ahead.groupby("customer_id")["line_revenue"].sum()
        assert (part["future_orders"] == part["customer_id"].map(orders).fillna(0)).all()
        assert np.allclose(part["future_revenue"], part["customer_id"].map(money).fillna(0))
        assert ((part["churn"] == 1) == (part["future_orders"] == 0)).all()


def test_rows_after_the_cutoff_do_not_matter(curated):
    late = F.col("invoice_date") > F.lit(TEMPORAL.cutoff_date).cast("timestamp_ntz")
    changed = curated.withColumn("line_revenue", F.when(late, 1e9).otherwise(F.col("line_revenue")))
    before = features.customer_features(curated, TEMPORAL).toPandas()
    after = features.customer_features(changed, TEMPORAL).toPandas()
    order = ["customer_id"]
    pd.testing.assert_frame_equal(
        before.sort_values(order, ignore_index=True), after.sort_values(order, ignore_index=True)
    )


def test_elapsed_days_are_whole_periods(spark):
    rows = [
        (1, "a", "2011-06-08 10:00:00", "10001", 1, 5.0),
        (2, "b", "2011-06-09 00:00:00", "10001", 1, 5.0),
        (2, "c", "2011-06-09 00:01:00", "10001", 1, 7.0),
    ]
    params = TemporalParams(cutoff_date="2011-06-09")
    got = collected(features.customer_features(curated_frame(spark, rows), params), "customer_id")
    assert [r["recency_days"] for r in got] == [0, 0]
    # The cutoff itself is observed, one minute later is not.
    assert got[1]["n_orders"] == 1 and got[1]["gross_revenue"] == 5.0


def test_single_order_and_missing_returns(spark):
    rows = [(1, "a", "2011-05-01 10:00:00", "10001", 2, 5.0)]
    got = collected(
        features.customer_features(
            curated_frame(spark, rows), TemporalParams(cutoff_date="2011-06-09")
        )
    )[0]
    assert got["is_single_purchase"] == 1 and got["avg_interval"] is None
    assert got["days_since_previous_purchase"] is None and got["interval_cv"] is None
    assert got["std_interval"] == 0.0 and got["return_value"] == 0.0
    assert got["recency_days"] == 38 and got["recency_to_interval_ratio"] == pytest.approx(1, abs=1e-6)


def test_window_edges_are_strict(spark):
    rows = [
        (1, "a", "2011-03-11 00:00:00", "10001", 1, 5.0),
        (1, "b", "2011-03-11 00:00:01", "10001", 1, 6.0),
    ]
    got = collected(
        features.customer_features(
            curated_frame(spark, rows), TemporalParams(cutoff_date="2011-06-09")
        )
    )[0]
    assert got["n_orders_90"] == 1 and got["revenue_90"] == 6.0 and got["revenue_prev_90"] == 5.0


def test_eligible_lines_only(spark):
    rows = [
        (1, "a", "2011-05-01 10:00:00", "10001", 2, 5.0),
        (1, "b", "2011-05-02 10:00:00", "10002", 2, 0.0),
    ]
    curated = curated_frame(spark, rows).withColumn(
        "is_monetary_eligible", ~F.col("is_cancellation") & (F.col("unit_price") > 0)
    )
    params = TemporalParams(cutoff_date="2011-06-09", eligible_lines_only=True)
    got = collected(features.customer_features(curated, params))[0]
    assert got["n_orders"] == 1 and got["n_unique_products"] == 1


def test_labels(spark):
    rows = [
        (1, "a", "2011-05-01 10:00:00", "10001", 1, 5.0),
        (1, "b", "2011-06-20 10:00:00", "10001", 3, 10.0),
        (2, "c", "2011-05-01 10:00:00", "10001", 1, 5.0),
        (2, "Cd", "2011-06-20 10:00:00", "10001", -1, 5.0),
        (3, "e", "2011-07-01 10:00:00", "10001", 1, 5.0),
        (4, "f", "2011-05-01 10:00:00", "10001", 1, 5.0),
        (4, "g", "2011-09-07 00:00:00", "10001", 1, 5.0),
        (5, "h", "2011-05-01 10:00:00", "10001", 1, 5.0),
        (5, "i", "2011-09-07 00:00:01", "10001", 1, 5.0),
    ]
    params = TemporalParams(cutoff_date="2011-06-09")
    got = collected(features.customer_labels(curated_frame(spark, rows), params), "customer_id")
    assert [(r["customer_id"], r["churn"]) for r in got] == [(1, 0), (2, 1), (4, 0), (5, 1)]
    assert got[0]["future_revenue"] == 30.0 and got[1]["future_revenue"] == 0.0
    assert str(got[0]["performance_end_date"]) == "2011-09-07 00:00:00"


def test_baseline(spark):
    rows = [
        (1, 20, 3, 500.0, 500.0, 0.0, 10.0, "A"),
        (2, 95, 2, 400.0, 400.0, 0.0, 20.0, "A"),
        (3, 90, 2, 300.0, 300.0, 0.0, 30.0, "A"),
        (4, 200, 1, 200.0, 200.0, 0.0, 40.0, "A"),
    ]
    schema = (
        "customer_id long, recency_days int, n_orders long, gross_revenue double, net_revenue "
        "double, return_value double, revenue_per_month double, country_grouped string"
    )
    scores = baseline.baseline_scores(spark.createDataFrame(rows, schema))
    assert [r["baseline_target"] for r in collected(scores, "customer_id")] == [
        False, True, False, True,
    ]
    labels = spark.createDataFrame(
        [(1, 0, 9.0), (2, 1, 0.0), (3, 1, 0.0), (4, 0, 5.0), (9, 1, 0.0)],
        "customer_id long, churn int, future_revenue double",
    ).withColumns(
        {
            "cutoff_date": F.lit("2011-06-09").cast("timestamp_ntz"),
            "performance_end_date": F.lit("2011-09-07").cast("timestamp_ntz"),
        }
    )
    report = collected(baseline.baseline_report(scores, labels))[0]
    counts = ["true_positives", "false_positives", "false_negatives", "true_negatives"]
    assert [report[c] for c in counts] == [1, 1, 1, 1]
    assert report["precision"] == report["recall"] == report["f1"] == 0.5
    assert report["potential_revenue_protected_proxy"] == 240.0
    assert report["observed_future_revenue_targeted"] == 5.0
    none = collected(baseline.baseline_report(scores, labels.filter("customer_id = 9")))[0]
    assert none["n_customers"] == 0 and none["precision"] == 0.0 and none["targeted_share"] == 0.0


def test_split_in_another_time_zone(spark):
    panel = spark.createDataFrame([(1, "2011-03-13"), (2, "2011-04-01")], "customer_id long, d string")
    panel = panel.withColumn("cohort_date", F.col("d").cast("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        chosen = collected(features.temporal_split(panel, ["2011-03-13"]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["customer_id"] for r in chosen] == [1]


def test_orders_are_not_repeated_per_cohort_before_a_shuffle(curated):
    """Seven cohorts multiplied every shuffled order and period by seven (F29 to F48)."""
    cutoffs = features.Cutoffs(("2010-06-01", "2010-08-15", "2010-09-01"), 90)
    once = features.orders_once(features.invoice_rollup(curated, cutoffs))
    for found in (features.cohort_purchase_days(once, cutoffs), features.cohort_medians(once, cutoffs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("dates", [("2010-06-01", "2010-09-01"), ("2010-06-01 06:30", "2010-09-01")])
def test_cohort_parts_equal_those_of_repeated_orders(curated, dates):
    """Also where cutoffs are not whole days apart, and for values of invoices that straddle one."""
    cutoffs = features.Cutoffs(dates, 90)
    once = features.orders_once(features.invoice_rollup(curated, cutoffs)).localCheckpoint()
    orders = features.seen_orders(once, cutoffs)
    days = features.cohort_purchase_days(once, cutoffs)
    for got, expected in (
        (features.interval_aggregates(days), features.interval_stats(orders)),
        (features.cohort_medians(once, cutoffs), features.median_order_value(orders)),
    ):
        keys = list(features.KEYS)
        got, expected = (
            x.toPandas().sort_values(keys, ignore_index=True) for x in (got.select(expected.columns), expected)
        )
        assert len(got) > 10
        pd.testing.assert_frame_equal(got, expected)
