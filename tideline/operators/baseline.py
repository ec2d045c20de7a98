"""The recency rule as a baseline, and its evaluation against the labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import zero_if_undefined
from tideline.params import VALUE_PROXY_DEFINITION, BaselineParams

COPIED = (
    "customer_id",
    "recency_days",
    "n_orders",
    "gross_revenue",
    "net_revenue",
    "return_value",
    "revenue_per_month",
    "country_grouped",
)


def baseline_scores(features: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """Target everyone inactive for too long; value is a year at the observed monthly rate."""
    return features.select(
        *COPIED,
        (F.col("recency_days") > params.inactivity_days).alias("baseline_target"),
        (F.col("revenue_per_month") * 12).alias("historical_value_proxy"),
    )


def baseline_report(
    scores: DataFrame, labels: DataFrame, params: BaselineParams = BaselineParams()
) -> DataFrame:
    """One row of counts, rates and money sums over the customers that have a label."""
    outcome = labels.select(
        "customer_id", "churn", "future_revenue", "cutoff_date", "performance_end_date"
    )
    joined = scores.join(outcome, "customer_id")
    hit, churned = F.col("baseline_target"), F.col("churn") == 1
    proxy = F.col("historical_value_proxy")

    def money(value, condition):
        return F.round(F.coalesce(F.sum(F.when(condition, value)), F.lit(0.0)), 2)

    counts = joined.agg(
        F.min("cutoff_date").cast("date").cast("string").alias("cutoff_date"),
        F.min("performance_end_date").cast("date").cast("string").alias("performance_end_date"),
        F.count(F.lit(1)).alias("n_customers"),
        F.count_if(hit).alias("n_targeted"),
        F.count_if(churned).alias("n_actual_churners"),
        F.count_if(hit & churned).alias("true_positives"),
        F.count_if(hit & ~churned).alias("false_positives"),
        F.count_if(~hit & churned).alias("false_negatives"),
        F.count_if(~hit & ~churned).alias("true_negatives"),
        money(F.col("gross_revenue"), hit).alias("historical_revenue_targeted"),
        money(proxy, hit).alias("future_value_proxy_targeted"),
        money(proxy, churned).alias("future_value_proxy_all_churners"),
        money(proxy, hit & churned).alias("potential_revenue_protected_proxy"),
        money(F.col("future_revenue"), hit).alias("observed_future_revenue_targeted"),
    )
    precision = zero_if_undefined(F.col("true_positives"), F.col("n_targeted"))
    recall = zero_if_undefined(F.col("true_positives"), F.col("n_actual_churners"))
    f1 = zero_if_undefined(2 * precision * recall, precision + recall)
    return counts.select(
        F.lit("baseline_recency_rule").alias("strategy"),
        F.lit(f"recency_days > {params.inactivity_days}").alias("rule"),
        F.lit(VALUE_PROXY_DEFINITION).alias(
            "value_proxy_definition"
        ),
        "*",
        F.round(zero_if_undefined(F.col("n_targeted"), F.col("n_customers")), 4).alias(
            "targeted_share"
        ),
        F.round(zero_if_undefined(F.col("n_actual_churners"), F.col("n_customers")), 4).alias(
            "overall_churn_rate"
        ),
        F.round(precision, 4).alias("precision"),
        F.round(recall, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
    )
