"""Preparation, fitting and explanation parts shared by the churn and value models."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    VectorAssembler,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.ordering import quantiles

#: Fits that run at the same time; each is a chain of short jobs that leaves cores idle.
SIDE_BY_SIDE = 4
T_ = TypeVar("T_")


@dataclass(frozen=True)
class FeatureColumns:
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]


def feature_selection(
    df: DataFrame,
    target: str,
    id_columns: Sequence[str],
    exclude: Sequence[str],
    categorical: Sequence[str],
) -> FeatureColumns:
    left_out = {target, *id_columns, *exclude}
    used = [f for f in df.schema.fields if f.name not in left_out]
    return FeatureColumns(
        tuple(
            f.name
            for f in used
            if f.name not in categorical and isinstance(f.dataType, T.NumericType)
        ),
        tuple(f.name for f in used if f.name in categorical),
    )


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, median): exact medians of many columns from one layout."""
    entries = [
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    stacked = df.select(F.inline(F.array(*entries)))
    return quantiles(stacked, "value", {"median": 0.5}, by=["feature"])


def impute_median(df: DataFrame, fit_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact medians of ``fit_on``."""
    values = {row["feature"]: row["median"] for row in medians(fit_on, columns).collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c))) for c in columns}
    )


def most_frequent(df: DataFrame, column: str) -> str | None:
    """The commonest value, the first in text order on a tie."""
    best = (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .count()
        .orderBy(F.col("count").desc(), column)
        .head()
    )
    return best[column] if best else None


def impute_mode(df: DataFrame, fit_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.fillna({c: v for c in columns if (v := most_frequent(fit_on, c)) is not None})


def standard_scale(df: DataFrame, fit_on: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Subtract the mean and divide by the population deviation of ``fit_on``."""
    stats = fit_on.agg(
        *[F.avg(c).alias(f"m_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
    ).head()
    return df.withColumns(
        {
            c: (F.col(c) - stats[f"m_{c}"]) / F.lit(stats[f"s_{c}"] or 1.0)
            for c in columns
        }
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows and weight per class: total / (classes x rows of the class)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.agg(
        F.struct(F.sum("n_rows").alias("rows"), F.count(F.lit(1)).alias("classes"))
    ).scalar()
    return counts.withColumn(
        "class_weight", totals["rows"] / (totals["classes"] * F.col("n_rows"))
    )


def with_class_weight(df: DataFrame, target: str, name: str = "class_weight") -> DataFrame:
    weights = {r[target]: r["class_weight"] for r in class_balance(df, target).collect()}
    chosen = F.lit(None).cast("double")
    for value, weight in weights.items():
        chosen = F.when(F.col(target) == value, F.lit(float(weight))).otherwise(chosen)
    return df.withColumn(name, chosen)


def one_hot_stages(columns: Sequence[str]) -> list:
    """Unknown categories share the last slot, which the encoder drops: all zeros."""
    if not columns:
        return []
    index = [f"{c}_index" for c in columns]
    return [
        StringIndexer(inputCols=list(columns), outputCols=index, handleInvalid="keep"),
        OneHotEncoder(inputCols=index, outputCols=[f"{c}_is" for c in columns], dropLast=True),
    ]


def preprocessing(
    columns: FeatureColumns, fit_on: DataFrame, scale: bool, compress: bool = False
) -> list:
    """Stages from feature columns to one vector column ``features``.

    ``compress`` takes signed logarithms first: models with a log link diverge on
    heavy tails.
    """
    filled = [f"{c}_filled" for c in columns.numeric]
    modes = {c: most_frequent(fit_on, c) for c in columns.categorical}
    known = [f"{c}_known" for c in columns.categorical]
    middle = {r["feature"]: r["median"] for r in medians(fit_on, columns.numeric).collect()}
    numbers_in = ", ".join(
        f"coalesce(nanvl(CAST({c} AS DOUBLE), NULL), CAST('{middle.get(c) or 0.0!r}' AS DOUBLE)) AS {c}_filled"
        for c in columns.numeric
    )
    stages: list = [SQLTransformer(statement=f"SELECT *, {numbers_in} FROM __THIS__")]
    if known:
        texts = {c: (modes[c] or "").replace("'", "\\'") for c in columns.categorical}
        extra = ", ".join(f"coalesce({c}, '{texts[c]}') AS {c}_known" for c in columns.categorical)
        stages.append(SQLTransformer(statement=f"SELECT *, {extra} FROM __THIS__"))
    stages += one_hot_stages(known)
    numbers = filled
    if compress:
        logs = ", ".join(f"signum({c}) * log1p(abs({c})) AS {c}_log" for c in filled)
        stages.append(SQLTransformer(statement=f"SELECT *, {logs} FROM __THIS__"))
        numbers = [f"{c}_log" for c in filled]
    if scale:
        stages += [
            VectorAssembler(inputCols=numbers, outputCol="numbers"),
            StandardScaler(
                inputCol="numbers", outputCol="numbers_scaled", withMean=True, withStd=True
            ),
        ]
        numbers = ["numbers_scaled"]
    stages.append(
        VectorAssembler(inputCols=[*numbers, *[f"{c}_is" for c in known]], outputCol="features")
    )
    return stages


def fit_pipeline(
    columns: FeatureColumns,
    fit_on: DataFrame,
    estimator,
    scale: bool,
    compress: bool = False,
    after: Sequence = (),
) -> PipelineModel:
    prepared = preprocessing(columns, fit_on, scale, compress)
    return Pipeline(stages=[*prepared, estimator, *after]).fit(fit_on)


def side_by_side(tasks: dict[str, Callable[[], T_]]) -> dict[str, T_]:
    """Run every task in a driver thread of its own and return the results by name.

    Iterative fits wait for the latency of one small job after the other. Side by side their
    jobs share the executors (evenly, where ``spark.scheduler.mode`` is FAIR). The threads
    inherit the caller's job properties; the first failure is raised once all have ended.
    """
    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
        inherited = inheritable_thread_target(SparkSession.active())
        started = {name: pool.submit(inherited(task)) for name, task in tasks.items()}
    return {name: future.result() for name, future in started.items()}


def fitted_model(model: PipelineModel):
    """The stage that predicts."""
    return next(s for s in reversed(model.stages) if hasattr(s, "numFeatures"))


def vector_names(columns: FeatureColumns, model: PipelineModel) -> list[str]:
    """Names of the vector's entries: numbers, then one per known category."""
    names = list(columns.numeric)
    for stage in model.stages:
        if type(stage).__name__ == "StringIndexerModel":
            for column, labels in zip(columns.categorical, stage.labelsArray):
                names += [f"{column}_{label}" for label in labels]
    return names


def feature_importance(columns: FeatureColumns, model: PipelineModel, name: str) -> DataFrame:
    """Tree importance or absolute coefficient per vector entry, largest first."""
    fitted = fitted_model(model)
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    else:
        values = abs(fitted.coefficients.toArray())
    rows = [
        (feature, float(value), name)
        for feature, value in zip(vector_names(columns, model), values)
    ]
    frame = SparkSession.active().createDataFrame(rows, "feature string, importance double, model string")
    return frame.orderBy(F.col("importance").desc(), "feature")

