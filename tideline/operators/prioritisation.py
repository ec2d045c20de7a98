"""Ranking customers for retention and comparing targeting strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.metrics import top_size
from tideline.functions.ordering import global_rank, quantiles
from tideline.functions.scalars import rounded
from tideline.params import CAPTURE_FRACTIONS, STRATEGY_SCORES, PriorityParams
from tideline.session import materialise

KEYS = ["customer_id", "cohort_date"]
UNKNOWN_SEGMENT = "Unknown"
RISK_LEVELS = ("Low", "Medium", "High")
RECOMMENDED, NAIVE = "revenue_at_risk", "recency_rule"


def priority_join(value_risk: DataFrame, test: DataFrame, segments: DataFrame) -> DataFrame:
    """Add recency, churn and segment; customers without a segment are "Unknown"."""
    return (
        value_risk.join(test.select(*KEYS, "recency_days", "churn"), KEYS, "left")
        .join(segments.select("customer_id", "segment_name"), "customer_id", "left")
        .fillna({"segment_name": UNKNOWN_SEGMENT})
    )


def priority_rank(df: DataFrame) -> DataFrame:
    order = [F.col("revenue_at_risk").desc(), F.col("customer_id"), F.col("cohort_date")]
    return global_rank(df, order, "priority_rank")


def risk_level(probability: Column) -> Column:
    """Low up to 0.34, Medium up to 0.67, High up to 1; null outside."""
    return (
        F.when((probability > -0.01) & (probability <= 0.34), "Low")
        .when((probability > 0.34) & (probability <= 0.67), "Medium")
        .when((probability > 0.67) & (probability <= 1.0), "High")
    )


def target_flags(df: DataFrame, budgets: Sequence[int]) -> DataFrame:
    return df.withColumns(
        {f"target_top_{b}": (F.col("priority_rank") <= b).cast("int") for b in budgets}
    )


def retention_priorities(
    value_risk: DataFrame,
    test: DataFrame,
    segments: DataFrame,
    params: PriorityParams = PriorityParams(),
) -> DataFrame:
    joined = priority_join(value_risk, test, segments)
    ranked = priority_rank(joined).withColumn("risk_level", risk_level(F.col("churn_probability")))
    return target_flags(ranked, params.budgets)


def high_value_threshold(
    df: DataFrame, params: PriorityParams = PriorityParams()
) -> DataFrame:
    return quantiles(df, "expected_future_clv", {"threshold": params.high_value_quantile})


def high_value_flag(df: DataFrame, params: PriorityParams = PriorityParams()) -> DataFrame:
    threshold = materialise(high_value_threshold(df, params)).scalar()
    return df.withColumn("is_high_value", F.col("expected_future_clv") >= threshold)


def rank_strategies(priorities: DataFrame, params: PriorityParams = PriorityParams()) -> DataFrame:
    """Every customer's rank under every strategy, from one layout of all scores."""
    flagged = high_value_flag(priorities, params)
    kept = [
        "customer_id", "revenue_at_risk", "expected_future_clv", "actual_future_revenue", "churn",
        "is_high_value",
    ]
    entries = [
        F.struct(
            F.lit(name).alias("strategy"), F.col(score).cast("double").alias("score"), *kept
        )
        for name, score in STRATEGY_SCORES.items()
    ]
    stacked = flagged.select(F.inline(F.array(*entries)))
    return global_rank(
        stacked, [F.col("score").desc(), F.col("customer_id")], "place", by=["strategy"]
    )


def _captured(inside: Column, name: str) -> Column:
    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.when(inside, F.col(column))), F.lit(0.0))

    return F.struct(
        F.count_if(inside).alias("n_targeted"),
        F.round(total("revenue_at_risk"), 2).alias("revenue_at_risk_captured"),
        F.round(total("expected_future_clv"), 2).alias("expected_clv_captured"),
        F.round(total("actual_future_revenue"), 2).alias("observed_future_revenue_captured"),
        F.sum(F.when(inside, F.col("churn"))).alias("actual_churners_captured"),
        rounded(F.avg(F.when(inside, F.col("churn")))).alias("actual_churn_precision"),
        F.count_if(inside & F.col("is_high_value")).alias("high_value_customers_captured"),
    ).alias(name)


def metrics_at_k(ranked: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """(strategy, budget) rows with what the top customers of each ranking hold."""
    wide = ranked.groupBy("strategy").agg(
        *[_captured(F.col("place") <= b, f"top_{b}") for b in budgets]
    )
    entries = F.array(
        *[F.struct(F.lit(int(b)).alias("budget"), F.col(f"top_{b}").alias("m")) for b in budgets]
    )
    return (
        wide.select("strategy", F.explode(entries).alias("_e"))
        .select("strategy", F.col("_e.budget").alias("budget"), "_e.m.*")
    )


def compare_strategies(
    priorities: DataFrame, params: PriorityParams = PriorityParams()
) -> DataFrame:
    return metrics_at_k(rank_strategies(priorities, params), params.budgets)


def strategy_totals(
    priorities: DataFrame, params: PriorityParams = PriorityParams()
) -> DataFrame:
    threshold = materialise(high_value_threshold(priorities, params)).scalar()
    marked = priorities.withColumn("_threshold", threshold)
    return marked.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        F.round(F.sum("expected_future_clv"), 2).alias("total_expected_clv"),
        F.sum("churn").alias("total_actual_churners"),
        F.round(F.sum("actual_future_revenue"), 2).alias("total_observed_future_revenue"),
        F.round(F.max("_threshold"), 2).alias("high_value_threshold_clv"),
        F.count_if(F.col("expected_future_clv") >= F.col("_threshold")).alias(
            "total_high_value_customers"
        ),
    )


def capture_curve(
    ranked: DataFrame, fractions: Sequence[float] = CAPTURE_FRACTIONS
) -> DataFrame:
    """Revenue at risk held by the top fraction of each ranking."""
    sized = ranked.withColumn(
        "_rows", ranked.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).scalar()
    )
    wide = sized.groupBy("strategy").agg(
        *[
            F.round(
                F.sum(
                    F.when(F.col("place") <= top_size(F.col("_rows"), f), F.col("revenue_at_risk"))
                ),
                2,
            ).alias(f"c{i}")
            for i, f in enumerate(fractions)
        ]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(float(f)).alias("fraction"),
                F.col(f"c{i}").alias("revenue_at_risk_captured"),
            )
            for i, f in enumerate(fractions)
        ]
    )
    return wide.select("strategy", F.explode(entries).alias("_e")).select("strategy", "_e.*")


def recency_rule_full(
    priorities: DataFrame, params: PriorityParams = PriorityParams()
) -> DataFrame:
    """Everyone inactive for too long, as one target group."""
    flagged = high_value_flag(priorities, params)
    inside = F.col("recency_days") > params.recency_threshold_days
    return flagged.agg(
        F.count_if(inside).alias("n_targeted"),
        rounded(F.avg(inside.cast("int"))).alias("coverage"),
        F.round(F.coalesce(F.sum(F.when(inside, F.col("revenue_at_risk"))), F.lit(0.0)), 2).alias(
            "revenue_at_risk_captured"
        ),
        F.sum(F.when(inside, F.col("churn"))).alias("actual_churners_captured"),
        rounded(F.avg(F.when(inside, F.col("churn")))).alias("actual_churn_precision"),
        F.count_if(inside & F.col("is_high_value")).alias("high_value_customers_captured"),
    )


def headline_uplift(comparison: DataFrame) -> DataFrame:
    """The recommended ranking against the recency rule at the smallest budget."""

    def held(strategy: str) -> Column:
        chosen = F.when(F.col("strategy") == strategy, F.col("revenue_at_risk_captured"))
        return F.min_by(chosen, F.when(F.col("strategy") == strategy, F.col("budget")))

    best = F.col("recommended_revenue_at_risk_captured")
    naive = F.col("naive_revenue_at_risk_captured")
    return comparison.agg(
        F.min("budget").alias("at_budget"),
        held(RECOMMENDED).alias("recommended_revenue_at_risk_captured"),
        held(NAIVE).alias("naive_revenue_at_risk_captured"),
    ).withColumns(
        {
            "absolute_uplift": F.round(best - naive, 2),
            "relative_uplift": rounded(F.try_divide(best - naive, naive)),
        }
    )


def prioritisation_report(
    priorities: DataFrame, params: PriorityParams = PriorityParams()
) -> DataFrame:
    """One row: budgets, totals, strategies, curves, the full rule and the headline."""
    ranked = materialise(rank_strategies(priorities, params))
    comparison = materialise(metrics_at_k(ranked, params.budgets))
    curve = capture_curve(ranked)

    def rows_of(df: DataFrame) -> Column:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar()

    def row_of(df: DataFrame) -> Column:
        return df.select(F.struct(*df.columns)).scalar()

    return priorities.sparkSession.range(1).select(
        F.array(*[F.lit(b) for b in params.budgets]).alias("budgets"),
        row_of(strategy_totals(priorities, params)).alias("totals"),
        rows_of(comparison).alias("strategies"),
        rows_of(curve).alias("capture_curves"),
        row_of(recency_rule_full(priorities, params)).alias("recency_rule_full"),
        F.lit(RECOMMENDED).alias("recommended_strategy"),
        row_of(headline_uplift(comparison)).alias("headline"),
    )
