"""Shapes of physical plans that have to hold at scale."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideline.operators import curation, features
from tideline.params import CurationParams
from tideline.plans import ALL_ORACLES, ALL_QUERIES, stages
from tideline.sources.star_schema import read_table

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_reads_only_what_it_needs(spark):
    plan = plan_of(features.invoice_rollup(stages.lean_curated(spark, SMALL), stages.cutoffs()))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "LessThanOrEqual(invoice_date" in scan
    assert "description" not in scan and "source_sheet" not in scan
    assert plan.count("Exchange hashpartitioning") == 1


def test_filters_reach_the_scan(spark):
    lines = read_table(spark, SMALL, "orders").filter("o_orderkey < 100").select("o_custkey")
    assert "LessThan(o_orderkey,100)" in plan_of(lines)


@pytest.mark.parametrize(
    "name",
    ["clean_transactions", "feature_assembly", "roc_auc", "concordance", "compare_strategies",
     "recommendation_table", "chi_square_assoc", "winsorise"],
)
def test_no_cross_joins_or_row_python(spark, name):
    plan = plan_of(ALL_QUERIES[name](spark, SMALL))
    for operator in ("CartesianProduct", "NestedLoop", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_lines_are_not_shuffled_on_country(spark):
    """Lines above the broadcast threshold meet the written list of countries in place."""
    lines = spark.range(3_000_000).select(
        F.when(F.col("id") % 3 > 0, "United Kingdom").otherwise(F.concat(F.lit("c"), F.col("id") % 9)).alias("country")
    )
    plan = plan_of(curation.country_grouping(lines, CurationParams(min_lines_per_country=10)))
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan and "hashpartitioning(country" not in plan


def test_every_regressor_covers_the_cohort():
    for name in ("ridge", "random_forest", "gradient_boosting", "tweedie"):
        assert name in stages.REGRESSORS
        assert f"'{name}'" in ALL_ORACLES["regressors_cover_the_cohort"]
