"""Quality reports, issue lists and the monthly business summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.scalars import count_if, money_sum
from tideline.params import ISSUE_TEXTS, REQUIRED_COLUMNS, QualityExpectations

ISSUE_TYPE = "array<struct<level:string,message:string>>"
CURATED_COLUMNS = (
    "country_grouped",
    "is_monetary_eligible",
    "is_outlier",
    "is_zero_price",
    "line_revenue_gross",
    "line_revenue_winsorised",
    "quantity_winsorised",
    "return_value",
)


def _issue(condition: Column, level: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(condition, F.struct(F.lit(level).alias("level"), text.alias("message")))


def _issues(*candidates: Column) -> Column:
    if not candidates:
        return F.array().cast(ISSUE_TYPE)
    return F.filter(F.array(*candidates), lambda issue: issue.isNotNull()).cast(ISSUE_TYPE)


def _dated(kind: str, found: Column, bound: Column) -> Column:
    dates = (found.cast("date").cast("string"), bound.cast("date").cast("string"))
    return F.format_string(ISSUE_TEXTS[kind], *dates)


def _has_error(issues: Column) -> Column:
    return F.exists(issues, lambda issue: issue["level"] == "error")


def _known(df: DataFrame, name: str, aggregate) -> Column:
    """An aggregate of a column that may be absent."""
    return aggregate(F.col(name)) if name in df.columns else F.lit(None).cast("double")


DISTINCT = {
    "n_customers": "customer_id",
    "n_invoices": "invoice_no",
    "n_products": "stock_code",
    "n_countries": "country",
}


def _distinct(df: DataFrame, name: str) -> Column:
    """Distinct values of a column that may be absent, by an aggregate of its own."""
    if name not in df.columns:
        return F.lit(None).cast("long")
    return df.agg(F.count_distinct(name)).scalar()


def dq_report(
    transactions: DataFrame, expected: QualityExpectations = QualityExpectations()
) -> DataFrame:
    """One row: counts, revenue, date range, issue list and the ``passed`` flag."""
    df = transactions
    absent = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    facts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        _known(df, "is_cancellation", count_if).cast("long").alias("n_cancellations"),
        _known(df, "line_revenue", money_sum).alias("total_net_revenue"),
        (
            money_sum(F.when(~F.col("is_cancellation"), F.col("line_revenue")))
            if {"is_cancellation", "line_revenue"} <= set(df.columns)
            else F.lit(0.0)
        ).alias("gross_revenue"),
        _known(df, "invoice_date", F.min).cast("timestamp_ntz").alias("invoice_date_min"),
        _known(df, "invoice_date", F.max).cast("timestamp_ntz").alias("invoice_date_max"),
        _known(df, "customer_id", lambda c: count_if(c.isNull())).alias("_null_customers"),
        _known(df, "invoice_date", lambda c: count_if(c.isNull())).alias("_null_dates"),
    ).withColumns({name: _distinct(df, column) for name, column in DISTINCT.items()})

    first, last = F.col("invoice_date_min"), F.col("invoice_date_max")
    filled = F.col("n_rows") > 0
    candidates = [_issue(~filled, "error", ISSUE_TEXTS["empty"])]
    candidates += [
        _issue(F.lit(True), "error", ISSUE_TEXTS["missing_column"].format(name)) for name in absent
    ]
    candidates += [
        _issue(
            F.col("_null_customers") > 0, "error", ISSUE_TEXTS["null_customer"]
        ),
        _issue(
            F.col("_null_dates") > 0, "error", ISSUE_TEXTS["null_date"]
        ),
        _issue(
            filled & (F.col("n_customers") < 2),
            "warning",
            ISSUE_TEXTS["few_customers"],
        ),
    ]
    if expected.min_invoice_date:
        bound = F.lit(expected.min_invoice_date).cast("timestamp_ntz")
        text = _dated("early", first, bound)
        candidates.append(_issue(first < bound, "warning", text))
    if expected.max_invoice_date:
        bound = F.lit(expected.max_invoice_date).cast("timestamp_ntz")
        text = _dated("late", last, bound)
        candidates.append(_issue(last > bound, "warning", text))

    money = {c: F.coalesce(F.round(c, 2), F.lit(0.0)) for c in ("total_net_revenue", "gross_revenue")}
    return (
        facts.withColumn("issues", _issues(*candidates))
        .withColumn("passed", ~_has_error(F.col("issues")))
        .withColumns(money)
        .drop("_null_customers", "_null_dates")
    )


def explode_issues(report: DataFrame) -> DataFrame:
    return report.select(F.inline("issues"))


def monthly_summary(transactions: DataFrame) -> DataFrame:
    return (
        transactions.groupBy("invoice_month")
        .agg(
            F.count(F.lit(1)).alias("n_transaction_lines"),
            F.count_distinct("invoice_no").alias("n_orders"),
            F.count_distinct("customer_id").alias("n_customers"),
            count_if(F.col("is_cancellation")).alias("n_cancellations"),
            money_sum(F.col("line_revenue")).alias("net_revenue"),
        )
        .orderBy("invoice_month")
    )


def curated_dq_report(
    curated: DataFrame, expected: QualityExpectations = QualityExpectations()
) -> DataFrame:
    """One row: curated counts and revenue, issue list and the ``passed`` flag.

    The sample of bad codes holds the five first ones in text order.
    """
    df = curated
    pattern = expected.stock_code_pattern
    absent = [c for c in CURATED_COLUMNS if c not in df.columns]
    bad_code = ~F.col("stock_code").rlike(pattern)
    nulls = (
        F.col("customer_id").isNull()
        | F.col("invoice_date").isNull()
        | F.col("line_revenue").isNull()
    )
    facts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("customer_id").alias("n_customers"),
        F.coalesce(_known(df, "is_zero_price", count_if), F.lit(0))
        .cast("long")
        .alias("n_zero_price_lines"),
        F.coalesce(_known(df, "is_outlier", count_if), F.lit(0))
        .cast("long")
        .alias("n_outliers_capped"),
        count_if(F.col("is_cancellation")).alias("n_returns"),
        F.count_distinct("country").alias("n_countries"),
        _known(df, "country_grouped", F.count_distinct).cast("long").alias("n_countries_grouped"),
        _known(df, "line_revenue_gross", money_sum).alias("gross_revenue"),
        money_sum(F.col("line_revenue")).alias("net_revenue"),
        count_if(bad_code).alias("_bad_codes"),
        count_if(F.col("unit_price") < 0).alias("_negative_prices"),
        count_if(nulls).alias("_null_rows"),
    )
    sample = (
        df.filter(bad_code)
        .groupBy("stock_code")
        .agg(F.lit(1))
        .orderBy("stock_code")
        .limit(5)
        .agg(F.array_sort(F.collect_list("stock_code")))
        .scalar()
    )
    facts = facts.withColumn("_sample", sample)
    listed = F.concat(F.lit("['"), F.array_join("_sample", "', '"), F.lit("']"))
    missing = str([c for c in CURATED_COLUMNS if c in absent])
    candidates = [
        _issue(F.col("n_rows") == 0, "error", ISSUE_TEXTS["empty_curated"]),
        _issue(F.lit(bool(absent)), "error", ISSUE_TEXTS["missing_curated"].format(missing)),
        _issue(
            F.col("_bad_codes") > 0,
            "error",
            F.concat(
                F.col("_bad_codes").cast("string"),
                F.lit(ISSUE_TEXTS["bad_codes"].format(pattern)),
                listed,
            ),
        ),
        _issue(
            F.col("_negative_prices") > 0,
            "error",
            F.concat(F.col("_negative_prices").cast("string"), F.lit(ISSUE_TEXTS["negative_price"])),
        ),
        _issue(
            F.col("_null_rows") > 0,
            "error",
            F.concat(F.col("_null_rows").cast("string"), F.lit(ISSUE_TEXTS["null_rows"])),
        ),
        _issue(
            F.col("n_zero_price_lines") > 0,
            "info",
            F.concat(
                F.col("n_zero_price_lines").cast("string"),
                F.lit(ISSUE_TEXTS["zero_price"]),
            ),
        ),
    ]
    money = {c: F.coalesce(F.round(c, 2), F.lit(0.0)) for c in ("gross_revenue", "net_revenue")}
    return (
        facts.withColumn("issues", _issues(*candidates))
        .withColumn("passed", ~_has_error(F.col("issues")))
        .withColumns(money)
        .drop("_bad_codes", "_negative_prices", "_null_rows", "_sample")
    )
