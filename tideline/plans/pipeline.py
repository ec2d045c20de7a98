"""The whole run: from raw lines to recommended actions, every result written to a folder."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import (
    baseline,
    explain,
    modelling,
    prioritisation,
    quality,
    recommendations,
    segmentation,
    survival,
    value,
)
from tideline.operators.churn import train_churn
from tideline.operators.cleaning import clean_transactions
from tideline.operators.curation import curate_transactions
from tideline.operators.features import (
    cohort_panel,
    customer_features,
    customer_labels,
    temporal_split,
)
from tideline.params import (
    ActionParams,
    BaselineParams,
    ChurnParams,
    CleaningParams,
    CurationParams,
    ExplainParams,
    PriorityParams,
    QualityExpectations,
    SegmentationParams,
    SurvivalParams,
    TemporalParams,
    ValueParams,
)
from tideline.sources import sinks


@dataclass(frozen=True)
class RunParams:
    cleaning: CleaningParams = CleaningParams()
    expected: QualityExpectations = QualityExpectations()
    curation: CurationParams = CurationParams()
    temporal: TemporalParams = TemporalParams()
    baseline: BaselineParams = BaselineParams()
    segmentation: SegmentationParams = field(default_factory=SegmentationParams)
    churn: ChurnParams = ChurnParams()
    survival: SurvivalParams = SurvivalParams()
    value: ValueParams = ValueParams()
    priority: PriorityParams = PriorityParams()
    explain: ExplainParams = ExplainParams()
    actions: ActionParams = field(default_factory=ActionParams)


class Datasets:
    """Written results by name: tables as parquet, summaries as CSV, reports as JSON."""

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str, df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
        self.tables[name] = sinks.write_table(df, f"{self.folder}/{name}", partition_by)
        return self.tables[name]

    def summary(self, name: str, df: DataFrame) -> None:
        sinks.write_summary(df, f"{self.folder}/{name}")

    def report(self, name: str, df: DataFrame) -> None:
        sinks.write_report(df, f"{self.folder}/{name}")


def run(raw: DataFrame, folder: str, params: RunParams = RunParams()) -> Datasets:
    """Run every stage. ``raw`` holds lines under canonical names, as ``load_raw`` gives them."""
    out = Datasets(folder)

    clean = out.table(
        "transactions", clean_transactions(raw, params.cleaning), ["invoice_month"]
    )
    out.report("data_quality_report", quality.dq_report(clean, params.expected))
    out.summary("transactions_summary", quality.monthly_summary(clean))
    curated = out.table(
        "transactions_curated", curate_transactions(clean, params.curation), ["invoice_month"]
    )
    out.report("curated_quality_report", quality.curated_dq_report(curated, params.expected))

    features = out.table("customer_features", customer_features(curated, params.temporal))
    labels = out.table("churn_labels", customer_labels(curated, params.temporal))
    scores = out.table("baseline_scores", baseline.baseline_scores(features, params.baseline))
    out.report("baseline_report", baseline.baseline_report(scores, labels, params.baseline))

    panel = out.table(
        "churn_model_input",
        cohort_panel(curated, params.churn.cohort_dates, params.temporal),
        ["cohort_date"],
    )
    train = temporal_split(panel, params.churn.train_cohorts)
    validation = temporal_split(panel, params.churn.validation_cohorts)
    test = temporal_split(panel, params.churn.test_cohorts)

    found = segmentation.segment_customers(features, params.segmentation)
    segments = out.table("customer_segments", found.segments)
    out.report("segmentation_model_report", found.report)
    data = out.table(
        "segment_data", segmentation.profile_joins(segments, features, labels, scores)
    )
    out.summary("segment_profiles", segmentation.segment_profiles(data, params=params.segmentation))
    out.summary(
        "rule_segment_profiles",
        segmentation.segment_profiles(data, "rule_segment", None, params.segmentation),
    )
    out.report(
        "segmentation_report", segmentation.segmentation_report(found, data, params.segmentation)
    )

    churn = train_churn(train, validation, test, params.churn)
    sinks.save_model(churn.model, f"{out.folder}/churn_model")
    churn_scores = out.table("churn_test_predictions", churn.predictions)
    out.summary("churn_feature_importance", churn.importance)
    out.report("churn_metrics", churn.report)

    worth = value.train_value(train, validation, test, params.value)
    value_scores = out.table("clv_test_predictions", worth.predictions)
    out.summary("clv_feature_importance", worth.importance)
    out.report("clv_metrics", worth.report)
    risk = out.table(
        "customer_value_risk",
        value.value_and_risk(test, value_scores, churn_scores, params.value),
    )
    out.report("revenue_at_risk_summary", value.risk_summary(risk, params.value))

    lives = out.table("survival_input", survival.survival_input(features, labels, segments))
    curves = out.table("survival_curves", survival.kaplan_meier(lives))
    fit = survival.cox_ph(lives, params.survival)
    ranked = modelling.impute_median(lives, lives, fit.features).withColumn("risk", fit.risk())
    index = survival.concordance(ranked, "duration", "event", "risk").head()["concordance_index"]
    out.report("survival_report", survival.survival_report(lives, curves, fit, index))

    priorities = out.table(
        "retention_priorities",
        prioritisation.retention_priorities(risk, test, segments, params.priority),
    )
    out.report(
        "prioritisation_report", prioritisation.prioritisation_report(priorities, params.priority)
    )

    why = explain.explain(churn.model, churn.columns, test, segments, params.explain)
    why = replace(why, shap=out.table("shap_values", why.shap))
    why = replace(
        why,
        importance=explain.global_importance(why.shap, why.names),
        factors=explain.customer_top_factors(why.shap, why.names, params.explain),
        segment_factors=explain.segment_factors(why.shap, why.names, segments, params.explain),
    )
    out.summary("shap_global_importance", why.importance)
    factors = out.table("customer_risk_factors", why.factors)
    out.report("explainability_report", explain.explain_report(why, churn.chosen_model))

    advice = out.table(
        "customer_recommendations",
        recommendations.recommendation_table(priorities, factors, params.actions),
    )
    out.report("recommendations_report", recommendations.recommendations_report(advice))
    return out


def headline(out: Datasets) -> DataFrame:
    """The result in one row: customers, value and what is at risk."""
    return out.tables["customer_recommendations"].agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.round(F.sum("expected_future_clv"), 2).alias("total_expected_clv"),
        F.round(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
    )
