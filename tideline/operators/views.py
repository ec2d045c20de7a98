"""The tables behind the report pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import lookup
from tideline.operators.prioritisation import RISK_LEVELS, high_value_flag
from tideline.operators.recommendations import action_summary, action_top_segments
from tideline.params import PriorityParams, SegmentationParams

AT_RISK = 0.5
TOP_CUSTOMERS = 10
SEARCH_LIMIT = 500
PROFILE_COLUMNS = (
    "recency_days",
    "n_orders",
    "net_revenue",
    "aov",
    "avg_interval",
    "return_value_ratio",
    "tenure_days",
    "active_months",
    "country_grouped",
)


def exec_kpis(recommendations: DataFrame, params: PriorityParams = PriorityParams()) -> DataFrame:
    at_risk = F.col("churn_probability") >= AT_RISK
    return high_value_flag(recommendations, params).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(~at_risk).alias("active_customers"),
        F.count_if(at_risk).alias("customers_at_risk"),
        F.round(F.sum("revenue_at_risk"), 2).alias("revenue_at_risk"),
        F.round(F.coalesce(F.sum(F.when(at_risk, F.col("expected_future_clv"))), F.lit(0.0)), 2)
        .alias("clv_at_risk"),
        F.count_if(at_risk & F.col("is_high_value")).alias("high_value_at_risk"),
    )


def risk_distribution(recommendations: DataFrame) -> DataFrame:
    """Customers per risk level in fixed order; absent levels count 0."""
    counted = recommendations.agg(
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in RISK_LEVELS]
    )
    entries = [
        F.struct(
            F.lit(i + 1).alias("position"),
            F.lit(level).alias("risk_level"),
            F.col(level).alias("n_customers"),
        )
        for i, level in enumerate(RISK_LEVELS)
    ]
    return counted.select(F.inline(F.array(*entries)))


def risk_by_segment(recommendations: DataFrame) -> DataFrame:
    return (
        recommendations.groupBy("segment_name")
        .agg(F.round(F.sum("revenue_at_risk"), 2).alias("revenue_at_risk"))
        .orderBy(F.col("revenue_at_risk").desc(), "segment_name")
    )


def top_customers(recommendations: DataFrame, count: int = TOP_CUSTOMERS) -> DataFrame:
    return (
        recommendations.orderBy("priority_rank")
        .limit(count)
        .select(
            "customer_id",
            "segment_name",
            "risk_level",
            "churn_probability",
            "expected_future_clv",
            "revenue_at_risk",
            "primary_action",
        )
    )


def top_actions(recommendations: DataFrame, count: int = 3) -> DataFrame:
    return action_summary(recommendations).limit(count)


def customer_search(
    recommendations: DataFrame,
    risk_levels: Sequence[str] = RISK_LEVELS,
    segments: Sequence[str] = (),
    id_part: str = "",
    limit: int = SEARCH_LIMIT,
) -> DataFrame:
    """Customers that pass all filters given, highest revenue at risk first."""
    found = recommendations.filter(F.col("risk_level").isin(list(risk_levels)))
    if segments:
        found = found.filter(F.col("segment_name").isin(list(segments)))
    if id_part:
        found = found.filter(F.col("customer_id").cast("string").contains(id_part))
    return (
        found.orderBy("priority_rank")
        .limit(limit)
        .select(
            "customer_id",
            "segment_name",
            "churn_probability",
            "expected_future_clv",
            "revenue_at_risk",
            "risk_level",
        )
    )


def customer_detail(
    customer_id: int, recommendations: DataFrame, factors: DataFrame, features: DataFrame
) -> DataFrame:
    """Scores, action, profile and ordered factors of one customer: a row per factor."""
    mine = F.col("customer_id") == customer_id
    return (
        recommendations.filter(mine)
        .join(features.filter(mine).select("customer_id", *PROFILE_COLUMNS), "customer_id", "left")
        .join(
            factors.filter(mine).select("customer_id", "rank", "feature", "shap_value", "direction"),
            "customer_id",
            "left",
        )
        .orderBy("rank")
    )


def segment_overview(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        "segment_name",
        "n_customers",
        "total_net_revenue",
        "avg_value_proxy",
        "observed_churn_rate",
        "revenue_at_risk_proxy",
        "recommended_strategy",
    ).orderBy(F.col("revenue_at_risk_proxy").desc(), "segment_name")


def segment_detail(
    segment: str,
    characteristics: DataFrame,
    factors: DataFrame,
    params: SegmentationParams = SegmentationParams(),
) -> DataFrame:
    """Characteristics beside risk factors by rank, with the segment's strategy."""
    mine = F.col("segment_name") == segment
    left = characteristics.filter(mine).select("rank", "feature", "direction")
    right = factors.filter(mine).select("rank", F.col("feature").alias("risk_factor"))
    strategy = lookup(params.strategies, F.lit(segment.split(" #")[0]))
    return left.join(right, "rank", "full").withColumn("recommended_strategy", strategy)


def budget_comparison(comparison: DataFrame, budget: int) -> DataFrame:
    return comparison.filter(F.col("budget") == budget).select(
        "strategy",
        "n_targeted",
        "revenue_at_risk_captured",
        "expected_clv_captured",
        "observed_future_revenue_captured",
        "high_value_customers_captured",
    )


def priority_mix(priorities: DataFrame, budget: int) -> DataFrame:
    return (
        priorities.filter(F.col("priority_rank") <= budget)
        .groupBy("segment_name")
        .agg(F.round(F.sum("revenue_at_risk"), 2).alias("revenue_at_risk"))
        .orderBy(F.col("revenue_at_risk").desc(), "segment_name")
    )


def action_list(recommendations: DataFrame, count: int = 8) -> DataFrame:
    """The strongest actions with their top segments as text."""
    text = F.concat("segment", F.lit(" ("), F.col("customers").cast("string"), F.lit(")"))
    tops = (
        action_top_segments(recommendations)
        .groupBy("action")
        .agg(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))).alias("_t"))
        .select("action", F.array_join(F.col("_t.text"), ", ").alias("top_segments"))
    )
    return action_summary(recommendations).limit(count).join(tops, "action")
