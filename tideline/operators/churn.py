"""Churn classifiers: fit, select, calibrate, evaluate and predict."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.metrics import (
    best_f1_threshold,
    brier,
    calibration_error,
    classification_metrics,
    top_fraction_capture,
)
from tideline.functions.scalars import rounded
from tideline.operators.boosting import Boost, BoostParams
from tideline.operators.calibration import calibrated, isotonic_pools
from tideline.operators.forest import Forest
from tideline.operators.modelling import (
    FeatureColumns,
    feature_importance,
    feature_selection,
    fit_pipeline,
    side_by_side,
    with_class_weight,
)
from tideline.params import ChurnParams
from tideline.session import materialise

RAW, CALIBRATED, FINAL = (
    "churn_probability_raw",
    "churn_probability_calibrated",
    "churn_probability",
)
WEIGHT = "class_weight"


@dataclass(frozen=True)
class ChurnResult:
    chosen_model: str
    model: PipelineModel
    columns: FeatureColumns
    calibration_applied: bool
    threshold: float
    metrics: DataFrame
    predictions: DataFrame
    importance: DataFrame
    report: DataFrame
    # Every candidate, and the scores of the chosen one on validation and test rows.
    models: dict[str, PipelineModel]
    scores: DataFrame


def churn_columns(panel: DataFrame, params: ChurnParams = ChurnParams()) -> FeatureColumns:
    return feature_selection(
        panel,
        params.target,
        params.id_columns,
        params.exclude_features,
        params.categorical_features,
    )


def classifier(name: str, rows: int, params: ChurnParams):
    common = {"featuresCol": "features", "labelCol": params.target, "weightCol": WEIGHT}
    if name == "logistic_regression":
        # Balanced weights add up to the number of rows.
        return LogisticRegression(
            maxIter=params.logistic_max_iter,
            regParam=1.0 / (params.logistic_c * rows),
            elasticNetParam=0.0,
            standardization=False,
            **common,
        )
    if name == "random_forest":
        forest = RandomForestClassifier(
            numTrees=params.forest_trees,
            maxDepth=params.forest_max_depth,
            minInstancesPerNode=params.forest_min_leaf,
            featureSubsetStrategy="sqrt",
            seed=params.seed,
            **common,
        )
        return Forest(forest)
    if name == "gradient_boosting":
        boosting = BoostParams(
            rounds=params.boosting_rounds,
            rate=params.boosting_rate,
            depth=params.boosting_depth,
            min_rows=params.boosting_min_rows,
            loss="logistic",
            row_share=params.boosting_subsample,
            feature_share=params.boosting_feature_share,
            seed=params.seed,
        )
        return Boost(labelCol=params.target, weight=WEIGHT, settings=json.dumps(asdict(boosting)))
    raise ValueError(f"unknown churn model: {name}")


def fit_classifier(
    name: str, train: DataFrame, columns: FeatureColumns, params: ChurnParams
) -> PipelineModel:
    weighted = with_class_weight(train, params.target, WEIGHT)
    estimator = classifier(name, train.count(), params)
    return fit_pipeline(columns, weighted, estimator, scale=name == "logistic_regression")


def fit_classifiers(
    train: DataFrame, columns: FeatureColumns, params: ChurnParams
) -> dict[str, PipelineModel]:
    """Every candidate, fitted side by side."""
    return side_by_side(
        {name: lambda n=name: fit_classifier(n, train, columns, params) for name in params.models}
    )


def score(model: PipelineModel, df: DataFrame, params: ChurnParams, name: str = RAW) -> DataFrame:
    """Ids, label and probability of churn."""
    probability = vector_to_array("probability")[1].alias(name)
    label = F.col(params.target).cast("int").alias("y_true")
    return model.transform(df).select(*params.id_columns, label, probability)


def score_candidates(
    models: dict[str, PipelineModel], splits: dict[str, DataFrame], params: ChurnParams
) -> DataFrame:
    """All candidates on all splits in long form: (model, split, ids, y_true, probability)."""
    parts = [
        score(model, df, params).select(
            F.lit(name).alias("model"), F.lit(split).alias("split"), "*"
        )
        for name, model in models.items()
        for split, df in splits.items()
    ]
    return materialise(reduce(lambda a, b: a.unionByName(b), parts))


def select_model(metrics: DataFrame, order: tuple[str, ...]) -> str:
    """Highest validation PR AUC; the order of the list breaks ties."""
    found = {
        r["model"]: r["pr_auc"]
        for r in metrics.filter("split = 'validation'").select("model", "pr_auc").collect()
    }
    return max(order, key=lambda name: found[name])


def calibrator(validation: DataFrame, method: str = "isotonic"):
    """Fit a map from raw to calibrated probability; returns frame -> frame."""
    if method == "isotonic":
        pools = materialise(isotonic_pools(validation, RAW, "y_true"))
        return lambda df: calibrated(df, RAW, pools, CALIBRATED)
    if method == "sigmoid":
        vector = VectorAssembler(inputCols=[RAW], outputCol="_raw_vector")
        model = LogisticRegression(
            featuresCol="_raw_vector",
            labelCol="y_true",
            predictionCol="_class",
            probabilityCol="_probability",
            rawPredictionCol="_margin",
        ).fit(vector.transform(validation))

        def apply(df: DataFrame) -> DataFrame:
            scored = model.transform(vector.transform(df))
            return scored.withColumn(CALIBRATED, vector_to_array("_probability")[1]).drop(
                "_raw_vector", "_class", "_probability", "_margin"
            )

        return apply
    raise ValueError(f"unknown calibration method: {method}")


def calibration_gate(scored: DataFrame, label: str, raw: str, calibrated: str) -> DataFrame:
    """Brier scores before and after, and whether calibration earns its use."""
    y = F.col(label)
    return scored.agg(
        brier(y, F.col(raw)).alias("brier_raw"),
        brier(y, F.col(calibrated)).alias("brier_calibrated"),
    ).withColumn("calibration_applied", F.col("brier_calibrated") < F.col("brier_raw"))


def predictions_table(test: DataFrame, final: Column, threshold: float) -> DataFrame:
    return test.withColumn(FINAL, final).withColumn(
        "churn_prediction", (F.col(FINAL) >= F.lit(threshold)).cast("int")
    )


def train_churn(
    train: DataFrame,
    validation: DataFrame,
    test: DataFrame,
    params: ChurnParams = ChurnParams(),
    models: dict[str, PipelineModel] | None = None,
) -> ChurnResult:
    """Choose, calibrate and report; ``models`` are candidates that have been fitted already."""
    columns = churn_columns(train, params)
    models = models or fit_classifiers(train, columns, params)
    scored = score_candidates(models, {"validation": validation, "test": test}, params)
    metrics = materialise(classification_metrics(scored, "y_true", RAW, by=["model", "split"]))
    best = select_model(metrics, params.models)

    mine = scored.filter(F.col("model") == best)
    calibrate = calibrator(mine.filter("split = 'validation'"), params.calibration_method)
    both = materialise(calibrate(mine))
    held, unseen = both.filter("split = 'validation'"), both.filter("split = 'test'")
    gate = calibration_gate(held, "y_true", RAW, CALIBRATED).head()
    use = bool(gate["calibration_applied"])
    final = CALIBRATED if use else RAW
    threshold = best_f1_threshold(held, "y_true", final).head()["threshold"]

    predictions = predictions_table(unseen.drop("model", "split"), F.col(final), threshold)
    importance = feature_importance(columns, models[best], best)
    report = _report(
        params, best, use, threshold, metrics, both, unseen, final, importance,
        {"train": train, "validation": validation, "test": test},
    )
    return ChurnResult(
        best, models[best], columns, use, threshold, metrics, predictions, importance, report,
        models, both,
    )


def _report(
    params, best, use, threshold, metrics, both, unseen, final, importance, splits
) -> DataFrame:
    """One row of nested structs."""
    spark = metrics.sparkSession
    shown = [c for c in metrics.columns if c not in ("model", "split", "n_rows")]

    def per_model(split: str) -> Column:
        picked = metrics.filter(F.col("split") == split)
        entry = F.struct("model", F.struct(*shown).alias("metrics"))
        return F.map_from_entries(picked.agg(F.collect_list(entry)).scalar())

    sizes = {
        name: df.agg(
            F.struct(F.count(F.lit(1)).alias("rows"), rounded(F.avg(params.target)).alias("rate"))
        ).scalar()
        for name, df in splits.items()
    }
    final_metrics = classification_metrics(
        unseen.withColumn("model", F.lit(best)), "y_true", final, ["model"], threshold
    )
    effect = both.groupBy("split").agg(
        rounded(brier(F.col("y_true"), F.col(RAW))).alias("brier_raw"),
        rounded(brier(F.col("y_true"), F.col(CALIBRATED))).alias("brier_calibrated"),
    )
    for suffix, column in (("raw", RAW), ("calibrated", CALIBRATED)):
        error = calibration_error(both, "y_true", column, ["split"]).select(
            "split", rounded(F.col("expected_calibration_error")).alias(f"ece_{suffix}")
        )
        effect = effect.join(error, "split")
    captures = top_fraction_capture(unseen, "y_true", final, params.id_columns[0], [0.10, 0.20])
    top = importance.limit(20)

    def rows_of(df: DataFrame) -> Column:
        return df.agg(F.collect_list(F.struct(*df.columns))).scalar()

    return spark.range(1).select(
        F.lit(best).alias("chosen_model"),
        F.lit("pr_auc (validation)").alias("selection_metric"),
        F.lit(params.calibration_method).alias("calibration_method"),
        F.lit(use).alias("calibration_applied"),
        F.lit("calibrated" if use else "raw").alias("probability_source"),
        F.lit(float(threshold)).alias("decision_threshold"),
        F.struct(*[s["rows"].alias(n) for n, s in sizes.items()]).alias("rows"),
        F.struct(*[s["rate"].alias(n) for n, s in sizes.items()]).alias("churn_rate"),
        per_model("validation").alias("validation_metrics"),
        per_model("test").alias("test_metrics"),
        final_metrics.select(F.struct(*shown)).scalar().alias("final_test_metrics"),
        rows_of(effect).alias("calibration_effect"),
        rows_of(captures).alias("business_metrics"),
        rows_of(top).alias("top_features"),
    )
