"""Reading transaction sources under one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.params import HEADER_NAMES, REQUIRED_COLUMNS

IDENTIFIERS = ("invoice_no", "stock_code", "description", "country", "source_sheet")


def plain_name(header: str) -> str:
    return "".join(c for c in header.lower() if c.isalnum())


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename loosely written headers to the canonical ones; touches the schema only."""
    plain = [plain_name(c) for c in df.columns]
    return df.toDF(*[HEADER_NAMES.get(name, name) for name in plain])


def cast_identifiers(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in IDENTIFIERS if c in df.columns})


def load_raw(sources: dict[str, DataFrame]) -> DataFrame:
    """Stack named sources by column name; columns a source lacks become null."""
    tagged = [
        normalise_headers(df).withColumn("source_sheet", F.lit(name))
        for name, df in sources.items()
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return cast_identifiers(stacked)


def read_source(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    """Parquet or CSV. CSV columns stay text: cleaning casts them."""
    if file_format == "csv":
        return spark.read.option("header", True).csv(path)
    return spark.read.format(file_format).load(path)


def load_raw_files(
    spark: SparkSession, paths: dict[str, str], file_format: str = "parquet"
) -> DataFrame:
    return load_raw({name: read_source(spark, p, file_format) for name, p in paths.items()})


def require_columns(df: DataFrame) -> DataFrame:
    """Fail on missing columns; keep the required ones and the provenance."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    extra = [c for c in ("source_sheet",) if c in df.columns]
    return df.select(*REQUIRED_COLUMNS, *extra)
