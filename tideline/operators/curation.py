"""Curation of cleaned lines: price flags, net and gross value, capped tails, countries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.ordering import quantiles
from tideline.params import RESIDUAL_ADMIN_CODES, CurationParams
from tideline.session import materialise

CAPPED_COLUMNS = ("quantity", "line_revenue")


def drop_residual_admin(df: DataFrame, codes: Sequence[str] = RESIDUAL_ADMIN_CODES) -> DataFrame:
    return df.filter(~F.col("stock_code").isin([c.upper() for c in codes]))


def flag_zero_price(df: DataFrame) -> DataFrame:
    return df.withColumn("is_zero_price", F.col("unit_price") <= 0)


def flag_monetary_eligible(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "is_monetary_eligible", ~F.col("is_cancellation") & ~F.col("is_zero_price")
    )


def gross_revenue_line(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "line_revenue_gross", F.when(F.col("is_cancellation"), 0.0).otherwise(F.col("line_revenue"))
    )


def return_value_line(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "return_value", F.when(F.col("is_cancellation"), -F.col("line_revenue")).otherwise(0.0)
    )


def winsor_bounds(df: DataFrame, params: CurationParams = CurationParams()) -> DataFrame:
    """(column, lower, upper): exact quantiles of both capped columns from one layout."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in CAPPED_COLUMNS
    ]
    stacked = df.select(F.inline(F.array(*entries)))
    cuts = {"lower": params.lower_quantile, "upper": params.upper_quantile}
    return quantiles(stacked, "value", cuts, by=["column"])


def winsorise(df: DataFrame, params: CurationParams = CurationParams()) -> DataFrame:
    bounds = materialise(winsor_bounds(df, params))
    capped = {}
    for name in CAPPED_COLUMNS:
        cut = bounds.filter(F.col("column") == name).select(F.struct("lower", "upper")).scalar()
        value = F.col(name)
        capped[f"{name}_winsorised"] = (
            F.when(value < cut["lower"], cut["lower"])
            .when(value > cut["upper"], cut["upper"])
            .otherwise(value)
        )
    return df.withColumns(capped)


def flag_outlier(df: DataFrame) -> DataFrame:
    per_column = {
        f"{c}_is_outlier": F.col(c) != F.col(f"{c}_winsorised") for c in CAPPED_COLUMNS
    }
    any_column = F.col("quantity_is_outlier") | F.col("line_revenue_is_outlier")
    return df.withColumns(per_column).withColumn("is_outlier", any_column)


def country_grouping(df: DataFrame, params: CurationParams = CurationParams()) -> DataFrame:
    """Keep countries with enough lines; the rest, and no country, become one label.

    The list of frequent countries is written, so its size is known when the join is planned
    and the planner's own threshold decides on a broadcast: lines are not shuffled on a country
    that most of them share.
    """
    frequent = materialise(
        df.filter(F.col("country").isNotNull())
        .groupBy(F.col("country").alias("_country"))
        .agg(F.count(F.lit(1)).alias("_lines"))
        .filter(F.col("_lines") >= params.min_lines_per_country)
        .select("_country")
    )
    return (
        df.join(frequent, F.col("country") == F.col("_country"), "left")
        .withColumn("country_grouped", F.coalesce("_country", F.lit(params.other_label)))
        .drop("_country")
    )


def curate_transactions(
    transactions: DataFrame, params: CurationParams = CurationParams()
) -> DataFrame:
    df = drop_residual_admin(transactions, params.residual_admin_codes)
    df = flag_monetary_eligible(flag_zero_price(df))
    df = return_value_line(gross_revenue_line(df))
    if params.cap_tails:
        df = flag_outlier(winsorise(df, params))
    return country_grouping(df, params)
