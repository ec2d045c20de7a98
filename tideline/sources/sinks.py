"""Writing tables, summaries, reports and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Parquet table; partition the panel by cohort and lines by month.

    Rebalancing brings a folder's rows together, so that not every task writes a file
    into every folder, and splits folders that hold too much for one task.
    """
    if partition_by:
        df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(
            *partition_by
        ).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_summary(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.option("header", True).schema(like.schema).csv(path)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document per row, nulls kept."""
    return df.select(
        F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("document")
    )


def write_report(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
