"""The stages wired to the star-schema tables, as the registered queries use them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.baseline import baseline_scores
from tideline.operators.cleaning import clean_transactions
from tideline.operators.curation import curate_transactions
from tideline.operators.churn import ChurnResult, churn_columns, fit_classifier, train_churn
from tideline.operators.explain import Explanation, customer_top_factors, explain
from tideline.operators.features import (
    Cutoffs,
    cohort_panel,
    customer_features,
    customer_labels,
    invoice_rollup,
    order_rollup,
    temporal_split,
)
from tideline.operators.prioritisation import retention_priorities
from tideline.operators.recommendations import recommendation_table
from tideline.operators.segmentation import (
    SegmentResult,
    name_clusters,
    profile_joins,
    rfm_rule_segments,
    segment_customers,
)
from tideline.operators.survival import survival_input
from tideline.operators.modelling import side_by_side
from tideline.operators.value import (
    ValueResult,
    fit_regressor,
    train_value,
    value_and_risk,
    value_columns,
)
from tideline.params import (
    CLUSTER_FEATURES,
    ChurnParams,
    CurationParams,
    PriorityParams,
    QualityExpectations,
    SegmentationParams,
    TemporalParams,
    ValueParams,
)
from tideline.session import materialise
from tideline.sources.star_schema import raw_transactions

# The tables run from 1995-01-01 to 2001-08-01.
CUTOFF = "2001-01-01"
TEMPORAL = TemporalParams(cutoff_date=CUTOFF)
EXPECTED = QualityExpectations(min_invoice_date="1996-01-01", max_invoice_date="2001-07-01")
MIN_COUNTRY_LINES = 2400
CURATION = CurationParams(min_lines_per_country=MIN_COUNTRY_LINES)
LEAN_CURATION = replace(CURATION, cap_tails=False)
COHORTS = ChurnParams(
    cohort_dates=(
        "2000-10-01",
        "2000-11-01",
        "2000-12-01",
        "2001-01-01",
        "2001-02-01",
        "2001-03-01",
        "2001-04-01",
    ),
    train_cohorts=("2000-10-01", "2000-11-01", "2000-12-01", "2001-01-01", "2001-02-01"),
    validation_cohorts=("2001-03-01",),
    test_cohorts=("2001-04-01",),
)


_written: dict[tuple[str, str, str], DataFrame] = {}
_fitted: dict[tuple[str, str, str], object] = {}


def stage_table(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> DataFrame:
    """A stage's result as a table written once per session and read by later stages."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        _written[key] = materialise(build())
    return _written[key]


def forget_stages() -> None:
    """Let the next query build its stages again, as the bench needs."""
    _written.clear()
    _fitted.clear()


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_transactions(spark, sf_dir)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(
        spark, sf_dir, "transactions", lambda: clean_transactions(raw(spark, sf_dir))
    )


def curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate_transactions(clean(spark, sf_dir), CURATION)


def lean_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated lines without the capped columns, which the features do not use."""
    return stage_table(
        spark,
        sf_dir,
        "transactions_curated",
        lambda: curate_transactions(clean(spark, sf_dir), LEAN_CURATION),
    )


def cutoffs() -> Cutoffs:
    return Cutoffs((CUTOFF,), TEMPORAL.performance_window_days)


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_rollup(lean_curated(spark, sf_dir), cutoffs(), TEMPORAL)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rollup(rollup(spark, sf_dir), cutoffs())


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(
        spark,
        sf_dir,
        "customer_features",
        lambda: customer_features(lean_curated(spark, sf_dir), TEMPORAL),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(
        spark,
        sf_dir,
        "churn_labels",
        lambda: customer_labels(lean_curated(spark, sf_dir), TEMPORAL),
    )


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(
        spark,
        sf_dir,
        "churn_model_input",
        lambda: cohort_panel(lean_curated(spark, sf_dir), COHORTS.cohort_dates, TEMPORAL),
    )


def split(spark: SparkSession, sf_dir: str, dates: tuple[str, ...]) -> DataFrame:
    return temporal_split(panel(spark, sf_dir), dates)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with a churn probability and a 90-day value by plain formulas.

    Stands in for the models where a result has to be checked value by value.
    """
    late = (F.col("recency_days") - 90) / F.lit(90.0)
    return panel(spark, sf_dir).withColumns(
        {
            "churn_probability": 1 / (1 + F.exp(-late)),
            "predicted_90d_value": F.greatest(F.col("revenue_per_month") * 3, F.lit(0.0)),
        }
    )


def scored_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal_split(scored(spark, sf_dir), COHORTS.test_cohorts)


def value_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = scored_test(spark, sf_dir)
    predicted = test.select(
        "customer_id",
        "cohort_date",
        F.col("future_revenue").alias("actual_future_revenue"),
        "predicted_90d_value",
    )
    return value_and_risk(test, predicted, test)


def rule_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with their rule segment, and clusters by order frequency named after it."""
    frequency = F.least(F.floor(F.col("n_orders") / 5), F.lit(4)).cast("int")
    clustered = features(spark, sf_dir).select("customer_id", frequency.alias("cluster"))
    rules = stage_table(
        spark, sf_dir, "rule_segments", lambda: rfm_rule_segments(features(spark, sf_dir))
    )
    return name_clusters(clustered.join(rules, "customer_id"))


def segment_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = features(spark, sf_dir)
    return profile_joins(
        rule_segments(spark, sf_dir), found, labels(spark, sf_dir), baseline_scores(found)
    )


def survival_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_rule = rule_segments(spark, sf_dir).select(
        "customer_id", F.col("rule_segment").alias("segment_name")
    )
    return survival_input(features(spark, sf_dir), labels(spark, sf_dir), by_rule)


PRIORITY = PriorityParams(budgets=(100, 250, 500, 1000))


def priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(
        spark,
        sf_dir,
        "retention_priorities",
        lambda: retention_priorities(
            value_risk(spark, sf_dir),
            scored_test(spark, sf_dir),
            rule_segments(spark, sf_dir),
            PRIORITY,
        ),
    )


ATTRIBUTED = CLUSTER_FEATURES


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the mean in deviations as a stand-in for model contributions."""
    test = scored_test(spark, sf_dir)
    overall = test.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in ATTRIBUTED],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in ATTRIBUTED],
        )
    ).scalar()
    distance = [
        F.coalesce((F.col(c) - F.col(f"_all.m_{c}")) / F.col(f"_all.s_{c}"), F.lit(0.0))
        for c in ATTRIBUTED
    ]
    return test.withColumn("_all", overall).select(
        "customer_id", "cohort_date", F.array(*distance).alias("shap")
    )


def factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_top_factors(attributions(spark, sf_dir), ATTRIBUTED)


def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_table(
        spark,
        sf_dir,
        "customer_recommendations",
        lambda: recommendation_table(priorities(spark, sf_dir), factors(spark, sf_dir)),
    )


VALUE = ValueParams()
#: The candidates, and the boosting of squared errors that selection leaves out by default.
REGRESSORS = (*VALUE.models, "gradient_boosting")
SEGMENTS = SegmentationParams()


def _fit_once(spark: SparkSession, sf_dir: str, name: str, fit: Callable[[], object]):
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _fitted:
        _fitted[key] = fit()
    return _fitted[key]


def three_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = (COHORTS.train_cohorts, COHORTS.validation_cohorts, COHORTS.test_cohorts)
    train, validation, test = (split(spark, sf_dir, dates) for dates in parts)
    return train, validation, test


def churn_model(spark: SparkSession, sf_dir: str, name: str) -> PipelineModel:
    """One churn candidate, fitted once per session and by itself."""

    def fit() -> PipelineModel:
        train = split(spark, sf_dir, COHORTS.train_cohorts)
        return fit_classifier(name, train, churn_columns(train, COHORTS), COHORTS)

    return _fit_once(spark, sf_dir, f"churn {name}", fit)


def value_model(spark: SparkSession, sf_dir: str, name: str) -> PipelineModel:
    """One value candidate, fitted once per session and by itself."""

    def fit() -> PipelineModel:
        train = split(spark, sf_dir, COHORTS.train_cohorts)
        return fit_regressor(name, train, value_columns(train, VALUE), VALUE)

    return _fit_once(spark, sf_dir, f"value {name}", fit)


def _candidates(spark: SparkSession, sf_dir: str, names, fit) -> dict[str, PipelineModel]:
    panel(spark, sf_dir)  # written once, before the fits read it side by side
    return side_by_side({name: lambda n=name: fit(spark, sf_dir, n) for name in names})


def churn_models(spark: SparkSession, sf_dir: str) -> dict[str, PipelineModel]:
    return _candidates(spark, sf_dir, COHORTS.models, churn_model)


def value_models(
    spark: SparkSession, sf_dir: str, names: tuple[str, ...] = VALUE.models
) -> dict[str, PipelineModel]:
    return _candidates(spark, sf_dir, names, value_model)


def churn_result(spark: SparkSession, sf_dir: str) -> ChurnResult:
    def train() -> ChurnResult:
        models = churn_models(spark, sf_dir)
        return train_churn(*three_splits(spark, sf_dir), COHORTS, models)

    return _fit_once(spark, sf_dir, "churn", train)


def value_result(spark: SparkSession, sf_dir: str) -> ValueResult:
    def train() -> ValueResult:
        models = value_models(spark, sf_dir)
        return train_value(*three_splits(spark, sf_dir), VALUE, models)

    return _fit_once(spark, sf_dir, "value", train)


def both_results(spark: SparkSession, sf_dir: str) -> tuple[ChurnResult, ValueResult]:
    """Both results, whose candidates are fitted side by side."""
    panel(spark, sf_dir)
    found = side_by_side(
        {
            "churn": lambda: churn_result(spark, sf_dir),
            "value": lambda: value_result(spark, sf_dir),
        }
    )
    return found["churn"], found["value"]


def segment_result(spark: SparkSession, sf_dir: str) -> SegmentResult:
    return _fit_once(
        spark,
        sf_dir,
        "segments",
        lambda: segment_customers(features(spark, sf_dir), SEGMENTS),
    )


def explanation(spark: SparkSession, sf_dir: str) -> Explanation:
    result = churn_result(spark, sf_dir)
    test = split(spark, sf_dir, COHORTS.test_cohorts)
    return explain(result.model, result.columns, test, segment_result(spark, sf_dir).segments)


def modelled_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value and risk from both fitted models."""

    def build() -> DataFrame:
        churn, value = both_results(spark, sf_dir)
        test = split(spark, sf_dir, COHORTS.test_cohorts)
        return value_and_risk(test, value.predictions, churn.predictions)

    return stage_table(spark, sf_dir, "modelled_value_risk", build)


def modelled_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain behind the flagship on fitted models: risk, priorities, contributions of the
    chosen churn model, actions."""
    ranked = retention_priorities(
        modelled_risk(spark, sf_dir),
        split(spark, sf_dir, COHORTS.test_cohorts),
        segment_result(spark, sf_dir).segments,
        PRIORITY,
    )
    return stage_table(
        spark,
        sf_dir,
        "modelled_recommendations",
        lambda: recommendation_table(materialise(ranked), explanation(spark, sf_dir).factors),
    )
