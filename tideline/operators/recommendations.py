"""Recommended action per customer and the executive summary by action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalars import lookup
from tideline.params import ActionParams

UNKNOWN = "unknown"
COLUMNS = (
    "customer_id",
    "segment_name",
    "risk_level",
    "priority_rank",
    "churn_probability",
    "expected_future_clv",
    "revenue_at_risk",
    "dominant_risk_factor",
    "dominant_direction",
    "primary_action",
    "rationale",
)


def dominant_factor(priorities: DataFrame, factors: DataFrame) -> DataFrame:
    """Add each customer's first factor; customers without one get "unknown"."""
    first = (
        factors.filter(F.col("rank") == 1)
        .groupBy("customer_id")
        .agg(F.min(F.struct("feature", "direction")).alias("_first"))
        .select(
            "customer_id",
            F.col("_first.feature").alias("dominant_risk_factor"),
            F.col("_first.direction").alias("dominant_direction"),
        )
    )
    return priorities.join(first, "customer_id", "left").fillna(
        {"dominant_risk_factor": UNKNOWN, "dominant_direction": UNKNOWN}
    )


def assign_action(df: DataFrame, params: ActionParams = ActionParams()) -> DataFrame:
    """The factor's action, else the segment's, else the fallback, with the reason."""
    by_factor = lookup(params.by_factor, F.col("dominant_risk_factor"))
    by_segment = lookup(params.by_segment, F.col("segment_name"))
    reason = (
        F.when(
            by_factor.isNotNull(),
            F.concat(F.lit("dominant risk factor: "), F.col("dominant_risk_factor")),
        )
        .when(by_segment.isNotNull(), F.concat(F.lit("segment: "), F.col("segment_name")))
        .otherwise("no specific signal")
    )
    return df.withColumns(
        {
            "primary_action": F.coalesce(by_factor, by_segment, F.lit(params.fallback)),
            "rationale": reason,
        }
    )


def recommendation_table(
    priorities: DataFrame, factors: DataFrame, params: ActionParams = ActionParams()
) -> DataFrame:
    """One row per customer; the priority rank is its order by revenue at risk."""
    return assign_action(dominant_factor(priorities, factors), params).select(*COLUMNS)


def action_summary(recommendations: DataFrame) -> DataFrame:
    return (
        recommendations.groupBy(F.col("primary_action").alias("action"))
        .agg(
            F.count(F.lit(1)).alias("n_customers"),
            F.round(F.sum("expected_future_clv"), 2).alias("total_expected_clv"),
            F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
            F.round(F.avg("churn_probability"), 4).alias("mean_churn_probability"),
        )
        .orderBy(F.col("total_revenue_at_risk").desc(), "action")
    )


def action_top_segments(recommendations: DataFrame, top: int = 3) -> DataFrame:
    """The largest segments of each action; counted first, so few rows are ranked."""
    counts = recommendations.groupBy(
        F.col("primary_action").alias("action"), F.col("segment_name").alias("segment")
    ).agg(F.count(F.lit(1)).alias("customers"))
    along = W.partitionBy("action").orderBy(F.col("customers").desc(), "segment")
    return counts.withColumn("rank", F.row_number().over(along)).filter(F.col("rank") <= top)


def nested_actions(recommendations: DataFrame) -> DataFrame:
    """The action summary with its top segments as a list."""
    tops = (
        action_top_segments(recommendations)
        .groupBy("action")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "segment", "customers"))).alias("_t"))
        .select(
            "action",
            F.transform(
                "_t",
                lambda e: F.struct(
                    e["segment"].alias("segment"), e["customers"].alias("customers")
                ),
            ).alias("top_segments"),
        )
    )
    return action_summary(recommendations).join(tops, "action")


def recommendations_report(recommendations: DataFrame) -> DataFrame:
    actions = nested_actions(recommendations)
    listed: Column = F.collect_list(
        F.struct((-F.col("total_revenue_at_risk")).alias("order"), *actions.columns)
    )
    return recommendations.agg(F.count(F.lit(1)).alias("n_customers")).withColumn(
        "actions", actions.agg(F.array_sort(listed)).scalar()
    )
