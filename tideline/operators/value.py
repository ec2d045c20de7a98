"""Value regressors, expected customer value and revenue at risk."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.regression import (
    GeneralizedLinearRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.metrics import regression_metrics, top_size
from tideline.functions.ordering import running_totals
from tideline.functions.scalars import clip, rounded, zero_if_undefined
from tideline.operators.boosting import Boost, BoostParams
from tideline.operators.forest import Forest
from tideline.operators.modelling import (
    FeatureColumns,
    feature_importance,
    feature_selection,
    fit_pipeline,
    side_by_side,
)
from tideline.params import ValueParams
from tideline.session import materialise

PERIOD_DAYS = 90.0
MAX_RETENTION = 0.999
MAX_RATIO = 0.999999
LINEAR = ("ridge",)
SCALED = "scaled_target"
PREDICTED = "predicted_90d_value"
ACTUAL = "actual_future_revenue"


@dataclass(frozen=True)
class ValueResult:
    chosen_model: str
    model: PipelineModel
    columns: FeatureColumns
    metrics: DataFrame
    predictions: DataFrame
    importance: DataFrame
    report: DataFrame
    # Every candidate.
    models: dict[str, PipelineModel]


def value_columns(panel: DataFrame, params: ValueParams = ValueParams()) -> FeatureColumns:
    return feature_selection(
        panel,
        params.target,
        params.id_columns,
        params.exclude_features,
        params.categorical_features,
    )


def regressor(name: str, rows: int, params: ValueParams):
    common = {"featuresCol": "features", "labelCol": params.target}
    if name == "ridge":
        return LinearRegression(
            regParam=params.ridge_alpha / rows, elasticNetParam=0.0, standardization=False, **common
        )
    if name == "random_forest":
        forest = RandomForestRegressor(
            numTrees=params.forest_trees,
            maxDepth=params.forest_max_depth,
            minInstancesPerNode=params.forest_min_leaf,
            # The regressor this stands for looks at every feature.
            featureSubsetStrategy="all",
            seed=params.seed,
            **common,
        )
        return Forest(forest)
    if name in ("tweedie", "gradient_boosting"):
        boosting = BoostParams(
            rounds=params.boosting_rounds,
            rate=params.boosting_rate,
            depth=params.boosting_depth,
            min_rows=params.boosting_min_rows,
            row_share=params.boosting_subsample,
            feature_share=params.boosting_feature_share,
            loss="tweedie" if name == "tweedie" else "squared",
            variance_power=params.tweedie_variance_power,
            seed=params.seed,
        )
        return Boost(settings=json.dumps(asdict(boosting)), **common)
    if name == "tweedie_glm":
        return GeneralizedLinearRegression(
            family="tweedie",
            variancePower=params.tweedie_variance_power,
            linkPower=0.0,
            regParam=params.tweedie_penalty,
            maxIter=50,
            featuresCol="features",
            labelCol=SCALED,
            predictionCol="scaled_prediction",
        )
    raise ValueError(f"unknown value model: {name}")


def fit_regressor(
    name: str, train: DataFrame, columns: FeatureColumns, params: ValueParams
) -> PipelineModel:
    estimator = regressor(name, train.count(), params)
    if name != "tweedie_glm":
        return fit_pipeline(columns, train, estimator, scale=name in LINEAR)
    # Around 1 the reweighted fits of the log link settle; on raw money they overflow.
    unit = train.agg(F.avg(params.target)).head()[0] or 1.0
    scaled = train.withColumn(SCALED, F.col(params.target) / F.lit(float(unit)))
    back = SQLTransformer(
        statement=f"SELECT *, scaled_prediction * {unit!r}D AS prediction FROM __THIS__"
    )
    return fit_pipeline(columns, scaled, estimator, scale=True, compress=True, after=[back])


def fit_regressors(
    train: DataFrame, columns: FeatureColumns, params: ValueParams
) -> dict[str, PipelineModel]:
    """Every candidate, fitted side by side."""
    return side_by_side(
        {name: lambda n=name: fit_regressor(n, train, columns, params) for name in params.models}
    )


def predict(model: PipelineModel, df: DataFrame, params: ValueParams) -> DataFrame:
    return model.transform(df).select(
        *params.id_columns,
        F.col(params.target).cast("double").alias(ACTUAL),
        F.col("prediction").alias(PREDICTED),
    )


def clv_predictions(model: PipelineModel, df: DataFrame, params: ValueParams) -> DataFrame:
    """Predicted value of the next 90 days, never below zero."""
    return predict(model, df, params).withColumn(PREDICTED, clip(F.col(PREDICTED), lower=0.0))


def select_regressor(metrics: DataFrame, order: tuple[str, ...], metric: str) -> str:
    """Lowest validation value of the metric; the order of the list breaks ties."""
    found = {
        r["model"]: r[metric]
        for r in metrics.filter("split = 'validation'").select("model", metric).collect()
    }
    return min(order, key=lambda name: found[name])


def train_value(
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    params: ValueParams = ValueParams(),
    models: dict[str, PipelineModel] | None = None,
) -> ValueResult:
    """Choose and report; ``models`` are candidates that have been fitted already."""
    columns = value_columns(train, params)
    models = models or fit_regressors(train, columns, params)
    parts = [
        predict(model, df, params).select(
            F.lit(name).alias("model"), F.lit(split).alias("split"), "*"
        )
        for name, model in models.items()
        for split, df in (("validation", validation), ("test", test))
    ]
    scored = materialise(reduce(lambda a, b: a.unionByName(b), parts))
    metrics = materialise(
        regression_metrics(scored, ACTUAL, PREDICTED, params.id_columns[0], ["model", "split"])
    )
    best = select_regressor(metrics, params.models, params.selection_metric)
    predictions = (
        scored.filter((F.col("model") == best) & (F.col("split") == "test"))
        .drop("model", "split")
        .withColumn(PREDICTED, clip(F.col(PREDICTED), lower=0.0))
    )
    importance = feature_importance(columns, models[best], best)
    report = _report(params, best, metrics, importance, train, validation, test)
    return ValueResult(
        best, models[best], columns, metrics, predictions, importance, report, models
    )


def _report(params, best, metrics, importance, train, validation, test) -> DataFrame:
    """One row of nested structs."""
    shown = [c for c in metrics.columns if c not in ("model", "split", "n_rows")]

    def per_model(split: str) -> Column:
        entry = F.struct("model", F.struct(*shown).alias("metrics"))
        picked = metrics.filter(F.col("split") == split)
        return F.map_from_entries(picked.agg(F.collect_list(entry)).scalar())

    top = importance.limit(20)
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return metrics.sparkSession.range(1).select(
        F.lit(best).alias("chosen_model"),
        F.lit(params.selection_metric).alias("selection_metric"),
        F.lit(params.target).alias("target"),
        size(train).alias("train_rows"),
        size(validation).alias("validation_rows"),
        size(test).alias("test_rows"),
        per_model("validation").alias("validation_metrics"),
        per_model("test").alias("test_metrics"),
        top.agg(F.collect_list(F.struct(*top.columns))).scalar().alias("top_features"),
    )


def value_formulas(df: DataFrame, params: ValueParams = ValueParams()) -> DataFrame:
    """Retention, value per active period, value over the horizon and revenue at risk.

    Value per active period is paid once per 90 days for as long as the customer
    stays, with constant retention: a geometric sum over the horizon.
    """
    periods = params.horizon_days / PERIOD_DAYS
    discount = (1.0 + params.discount_rate_annual) ** (-PERIOD_DAYS / 365.0)
    p = F.col("churn_probability")
    kept = F.col("retention_probability")
    ratio = clip(kept * discount, upper=MAX_RATIO)
    return (
        df.withColumn(
            "retention_probability", clip(1.0 - p, params.min_retention_probability, MAX_RETENTION)
        )
        .withColumn("value_per_active_period", F.col(PREDICTED) / kept)
        .withColumn(
            "expected_future_clv",
            F.col("value_per_active_period") * ((1.0 - F.pow(ratio, F.lit(periods))) / (1.0 - ratio)),
        )
        .withColumn("revenue_at_risk", p * F.col("expected_future_clv"))
    )


def value_and_risk(
    test: DataFrame,
    value_predictions: DataFrame,
    churn_predictions: DataFrame,
    params: ValueParams = ValueParams(),
) -> DataFrame:
    """One row per customer and cohort that has both predictions. Not sorted: see report views."""
    keys = list(params.id_columns)
    history = test.select(
        *keys,
        F.col("net_revenue").alias("historical_value"),
        F.col("n_orders").alias("historical_orders"),
    )
    joined = history.join(value_predictions, keys).join(
        churn_predictions.select(*keys, "churn_probability"), keys
    )
    return value_formulas(joined, params).select(
        *keys,
        "historical_value",
        "historical_orders",
        "churn_probability",
        "retention_probability",
        PREDICTED,
        "value_per_active_period",
        "expected_future_clv",
        "revenue_at_risk",
        ACTUAL,
    )


def largest_share(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """One row: total, the sum of the largest ``fraction`` of values and its share.

    Works on distinct values with counts, so equal values never need a tie-break.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("amount", F.col(value) * F.col("n"))
    )
    placed = running_totals(
        counted, [F.col(value).desc()], {"upto": F.col("n")}, sizes={"rows": "upto"}
    )
    room = top_size(F.col("rows"), fraction) - (F.col("upto") - F.col("n"))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), room))
    return placed.agg(
        F.max("rows").alias("n_rows"),
        F.sum("amount").alias("total"),
        F.sum(taken * F.col(value)).alias("top_total"),
    ).withColumn("top_share", zero_if_undefined(F.col("top_total"), F.col("total")))


def risk_summary(value_risk: DataFrame, params: ValueParams = ValueParams()) -> DataFrame:
    money = lambda c: F.round(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    share = largest_share(value_risk, "revenue_at_risk", 0.10)
    return value_risk.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.lit(params.horizon_days).alias("horizon_days"),
        F.lit(params.discount_rate_annual).alias("discount_rate_annual"),
        F.lit(params.min_retention_probability).alias("min_retention_probability"),
        rounded(F.avg("churn_probability")).alias("mean_churn_probability"),
        money("historical_value").alias("total_historical_value"),
        money(PREDICTED).alias("total_predicted_90d_value"),
        money("expected_future_clv").alias("total_expected_future_clv"),
        money("revenue_at_risk").alias("total_revenue_at_risk"),
    ).withColumn(
        "revenue_at_risk_top_decile_share", rounded(share.select("top_share").scalar())
    )
