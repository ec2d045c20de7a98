"""The whole run on the smallest tables, and the driver contract."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

import pytest

from tests.check_oracle import compare, connect
from tests.frames import only
from tideline.params import ValueParams
from tideline.plans import ALL_ORACLES, ALL_QUERIES, pipeline, stages
from tideline.sources.star_schema import raw_transactions

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def test_run(spark, tmp_path):
    params = pipeline.RunParams(
        expected=stages.EXPECTED,
        curation=replace(stages.CURATION, min_lines_per_country=200),
        temporal=stages.TEMPORAL,
        segmentation=replace(stages.SEGMENTS, k_range=(2, 3), kmeans_restarts=1),
        churn=replace(
            stages.COHORTS, logistic_max_iter=100, forest_trees=5, forest_max_depth=6,
            boosting_rounds=2, boosting_depth=4,
        ),
        value=ValueParams(forest_trees=5, boosting_rounds=2, boosting_depth=2, forest_max_depth=3),
    )
    out = pipeline.run(raw_transactions(spark, SMALL), str(tmp_path / "run"), params)
    tables = out.tables
    customers = tables["customer_recommendations"].count()
    assert customers == tables["customer_value_risk"].count()
    assert tables["customer_segments"].count() == tables["customer_features"].count()
    factors = tables["customer_risk_factors"]
    assert factors.count() == 5 * tables["churn_test_predictions"].count()
    probability = tables["churn_test_predictions"]
    assert probability.filter("churn_probability < 0 OR churn_probability > 1").count() == 0
    assert tables["clv_test_predictions"].filter("predicted_90d_value < 0").count() == 0
    assert only(pipeline.headline(out))["n_customers"] == customers
    for name in ("churn_metrics", "explainability_report", "recommendations_report"):
        text = spark.read.text(f"{out.folder}/{name}").head()[0]
        assert json.loads(text)


def test_every_sql_belongs_to_a_query():
    assert set(ALL_ORACLES) <= set(ALL_QUERIES)


@pytest.mark.parametrize(
    "name",
    [
        "clean_transactions", "dq_issues", "curated_dq_issues", "feature_assembly", "churn_labels",
        "regression_metrics", "roc_auc", "rfm_rule_segments", "compare_strategies",
        "recommendation_table", "one_hot", "baseline_report",
    ],
)
def test_query_against_sql(spark, name):
    status, note = compare(spark, connect(SMALL), SMALL, ALL_QUERIES[name], ALL_ORACLES[name])
    assert status == "ok", note
