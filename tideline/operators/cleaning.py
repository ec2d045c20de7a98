"""Cleaning of raw transaction lines. Each step maps a frame to a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import month_text
from tideline.params import NON_PRODUCT_CODES, CleaningParams
from tideline.sources.loaders import require_columns

USABLE_COLUMNS = ("invoice_no", "stock_code", "invoice_date", "quantity", "unit_price")


def clean_strings(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "invoice_no": F.trim("invoice_no"),
            "stock_code": F.upper(F.trim("stock_code")),
            "description": F.trim("description"),
            "country": F.trim("country"),
        }
    )


def coerce_timestamp(df: DataFrame) -> DataFrame:
    """Unreadable dates become null."""
    return df.withColumn("invoice_date", F.col("invoice_date").try_cast("timestamp_ntz"))


def coerce_numeric(df: DataFrame) -> DataFrame:
    """Unreadable and NaN numbers become null."""

    def number(name: str) -> Column:
        value = F.col(name).try_cast("double")
        return F.when(~F.isnan(value), value)

    return df.withColumns(
        {
            "quantity": number("quantity"),
            "unit_price": number("unit_price"),
            "customer_id": number("customer_id").try_cast("long"),
        }
    )


def drop_unusable(df: DataFrame) -> DataFrame:
    return df.dropna(subset=list(USABLE_COLUMNS))


def drop_anonymous(df: DataFrame) -> DataFrame:
    return df.filter(F.col("customer_id").isNotNull())


def flag_cancellation(df: DataFrame) -> DataFrame:
    starts = F.upper("invoice_no").startswith("C")
    return df.withColumn("is_cancellation", F.coalesce(starts, F.lit(False)))


def flag_return(df: DataFrame) -> DataFrame:
    return df.withColumn("is_return", F.col("is_cancellation") & (F.col("quantity") < 0))


def line_revenue(df: DataFrame) -> DataFrame:
    return df.withColumn("line_revenue", (F.col("quantity") * F.col("unit_price")).cast("double"))


def flag_non_product(df: DataFrame, codes: Sequence[str] = NON_PRODUCT_CODES) -> DataFrame:
    return df.withColumn("is_non_product", F.col("stock_code").isin([c.upper() for c in codes]))


def drop_non_product(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_non_product"))


def dedup_lines(df: DataFrame, ignore_source: bool = False) -> DataFrame:
    """Drop exact duplicates; by default the source is part of a line's identity."""
    if ignore_source and "source_sheet" in df.columns:
        keys = [c for c in df.columns if c != "source_sheet"]
        return df.groupBy(*keys).agg(F.min("source_sheet").alias("source_sheet"))
    return df.dropDuplicates()


def invoice_month(df: DataFrame) -> DataFrame:
    return df.withColumn("invoice_month", month_text(F.col("invoice_date")))


def clean_transactions(raw: DataFrame, params: CleaningParams = CleaningParams()) -> DataFrame:
    df = coerce_numeric(coerce_timestamp(clean_strings(require_columns(raw))))
    df = drop_unusable(df)
    if params.drop_missing_customer:
        df = drop_anonymous(df)
    df = flag_non_product(df, params.non_product_codes)
    if params.drop_non_product:
        df = drop_non_product(df)
    # Flags and revenue follow from the columns compared here, so they can wait.
    df = dedup_lines(df, params.dedup_ignores_source)
    return invoice_month(line_revenue(flag_return(flag_cancellation(df))))
