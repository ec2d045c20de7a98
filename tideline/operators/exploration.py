"""Exploratory statistics on raw lines, cleaned lines and customers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tideline.functions.ordering import quantiles, running_totals
from tideline.functions.scalars import count_if, elapsed_days, money_sum, month_text
from tideline.operators.value import largest_share
from tideline.session import materialise

PERCENTILES = {"p1": 0.01, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def with_helper_columns(raw: DataFrame) -> DataFrame:
    """Cancellation, revenue, month and missing-customer flag on raw lines."""
    return raw.withColumns(
        {
            "is_cancellation": F.coalesce(F.upper("invoice_no").startswith("C"), F.lit(False)),
            "line_revenue": F.col("quantity").try_cast("double")
            * F.col("unit_price").try_cast("double"),
            "invoice_month": month_text(F.col("invoice_date")),
            "missing_customer": F.col("customer_id").isNull(),
        }
    )


def column_profile(df: DataFrame) -> DataFrame:
    """(column, type, distinct, missing, percent missing).

    Each column's distinct values are counted by an aggregate of their own, which reads and
    shuffles that column only; in one aggregate every row would be copied once per column.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(c).alias(f"n_{c}") for c in df.columns],
    ).withColumns({f"d_{c}": df.agg(F.count_distinct(c)).scalar() for c in df.columns})
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"d_{f.name}").alias("n_unique"),
            (F.col("_rows") - F.col(f"n_{f.name}")).alias("n_missing"),
            F.round((1 - F.col(f"n_{f.name}") / F.col("_rows")) * 100, 2).alias("pct_missing"),
        )
        for f in df.schema.fields
    ]
    return counts.select(F.inline(F.array(*entries)))


def missing_by_group(lines: DataFrame, group: str) -> DataFrame:
    missing = F.col("missing_customer")
    return lines.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        count_if(missing).alias("n_missing"),
        (count_if(missing) * 100 / F.count(F.lit(1))).alias("pct_missing"),
    )


def chi_square_tail(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution by its recurrence in the shape."""
    x = statistic / 2.0
    if x <= 0 or dof < 1:
        return 1.0
    shape, total = (0.5, math.erfc(math.sqrt(x))) if dof % 2 else (1.0, math.exp(-x))
    while shape < dof / 2.0:
        total += math.exp(shape * math.log(x) - x - math.lgamma(shape + 1.0))
        shape += 1.0
    return min(total, 1.0)


def chi_square_assoc(df: DataFrame, row: str, column: str) -> DataFrame:
    """Pearson chi-square of two columns with Cramer's V; rows without a value are left out."""
    # One row per pair of values, read several times below. Counts as doubles: products of
    # counts outgrow a long.
    cells = materialise(
        df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
        .groupBy(row, column)
        .agg(F.count(F.lit(1)).alias("_o"))
    )
    return _chi_square_of_cells(cells, row, column)


def _chi_square_of_cells(cells: DataFrame, row: str, column: str) -> DataFrame:
    cells = cells.withColumn("_o", F.col("_o").cast("double"))
    by_row = cells.groupBy(row).agg(F.sum("_o").alias("_r"))
    by_column = cells.groupBy(column).agg(F.sum("_o").alias("_c"))
    # sum of (o - e)^2 / e = n (sum of o^2 / (r c) - 1); empty cells add nothing to it.
    shares = (
        cells.join(by_row, row)
        .join(by_column, column)
        .agg(
            F.sum("_o").cast("long").alias("n"),
            F.sum(F.col("_o") * F.col("_o") / (F.col("_r") * F.col("_c"))).alias("s"),
        )
    )
    rows, columns = (
        part.agg(F.struct(F.count(F.lit(1)).alias("k"), F.sum(1 / F.col(size)).alias("inv"))).scalar()
        for part, size in ((by_row, "_r"), (by_column, "_c"))
    )
    raw = shares.withColumns({"_rows": rows, "_columns": columns}).select(
        "n",
        ((F.col("_rows.k") - 1) * (F.col("_columns.k") - 1)).alias("dof"),
        F.least("_rows.k", "_columns.k").alias("_short"),
        (F.col("n") * (F.col("s") - 1)).alias("_plain"),
        # Sum over all cells of 1 / e.
        (F.col("n") * F.col("_rows.inv") * F.col("_columns.inv")).alias("_inverse"),
    )
    # In a two by two table all |o - e| are equal; they shrink by one half there.
    gap = F.greatest(F.sqrt(F.col("_plain") / F.col("_inverse")) - 0.5, F.lit(0.0))
    chi2 = F.when(F.col("dof") == 1, gap * gap * F.col("_inverse")).otherwise(F.col("_plain"))
    facts = raw.withColumn("chi2", chi2).select(
        "chi2",
        "dof",
        F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.col("_short") - 1))).alias("cramers_v"),
        "n",
    )
    found = facts.head()
    tail = chi_square_tail(found["chi2"] or 0.0, int(found["dof"] or 0))
    return _fixed(facts, found).withColumn("p_value", F.lit(tail))


def _fixed(df: DataFrame, row: Row) -> DataFrame:
    """The one row of ``df`` that is known already, without running ``df`` again."""
    return df.sparkSession.createDataFrame([row], df.schema)


def mann_whitney(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Two-sided U test of ``value`` between rows with ``first`` and the others.

    Works on distinct values: average ranks for ties, tie-corrected normal p-value
    with continuity correction.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("v"))
        .agg(
            F.count(F.lit(1)).cast("double").alias("t"),
            count_if(first).cast("double").alias("a"),
        )
    )
    placed = running_totals(counted, [F.col("v")], {"upto": F.col("t")})
    rank = F.col("upto") - (F.col("t") - 1) / 2
    t, n1, n2 = F.col("t"), F.col("n_first"), F.col("n_second")
    n = n1 + n2
    sums = placed.agg(
        F.sum("a").alias("n_first"),
        (F.sum("t") - F.sum("a")).alias("n_second"),
        F.sum(F.col("a") * rank).alias("_ranks"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    facts = sums.select(
        "n_first",
        "n_second",
        (F.col("_ranks") - n1 * (n1 + 1) / 2).alias("u_statistic"),
        F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("_ties") / (n * (n - 1)))).alias("sigma"),
    ).withColumn(
        "z", (F.abs(F.col("u_statistic") - n1 * n2 / 2) - 0.5) / F.nullif("sigma", F.lit(0.0))
    )
    found = facts.head()
    z = found["z"]
    tail = 1.0 if z is None else min(1.0, math.erfc(z / math.sqrt(2)))
    return _fixed(facts, found).drop("sigma").withColumn("p_value", F.lit(tail))


def group_behaviour(lines: DataFrame, group: str = "missing_customer") -> DataFrame:
    """Rates, means and exact medians per group."""
    flat = lines.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(F.col("is_cancellation").cast("int")).alias("cancellation_rate"),
        F.avg((F.col("line_revenue") < 0).cast("int")).alias("negative_line_rate"),
        (money_sum(F.col("line_revenue")) / F.count("line_revenue")).alias("mean_line_revenue"),
        F.avg("quantity").alias("mean_quantity"),
    )
    for column in ("line_revenue", "unit_price"):
        flat = flat.join(quantiles(lines, column, {f"median_{column}": 0.5}, by=[group]), group)
    return flat


def missing_description(lines: DataFrame, top: int = 10) -> DataFrame:
    """How many lines lack a description, how concentrated they are and how they behave."""
    missing = F.col("description").isNull()
    codes = (
        lines.filter(missing)
        .groupBy("stock_code")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "stock_code")
        .limit(top)
    )
    cancelled = F.col("is_cancellation").cast("int")
    return (
        lines.agg(
            count_if(missing).alias("n_missing"),
            (count_if(missing) * 100 / F.count(F.lit(1))).alias("pct_missing"),
            F.count_distinct(F.when(missing, F.col("stock_code"))).alias("n_codes"),
            F.avg(F.when(missing, cancelled)).alias("cancel_rate_missing"),
            F.avg(F.when(~missing, cancelled)).alias("cancel_rate_present"),
            F.avg(F.when(missing, F.col("quantity"))).alias("mean_quantity_missing"),
            F.avg(F.when(~missing, F.col("quantity"))).alias("mean_quantity_present"),
        )
        .withColumn("_top", codes.agg(F.sum("n")).scalar())
        .withColumn("top_codes_share", F.try_divide(F.col("_top") * 100, F.col("n_missing")))
        .drop("_top")
    )


def missing_description_codes(lines: DataFrame, top: int = 10) -> DataFrame:
    return (
        lines.filter(F.col("description").isNull())
        .groupBy("stock_code")
        .agg(F.count(F.lit(1)).alias("n_lines"))
        .orderBy(F.col("n_lines").desc(), "stock_code")
        .limit(top)
    )


def sample_skewness(value: Column) -> Column:
    """Skewness with the small-sample correction."""
    n = F.count(value)
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: Column) -> Column:
    """Excess kurtosis with the small-sample correction."""
    n = F.count(value)
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)
    return F.when(n > 3, corrected)


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: moments and exact percentiles."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns
    ]
    stacked = df.select(F.inline(F.array(*entries)))
    value = F.col("value")
    moments = stacked.groupBy("column").agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        sample_skewness(value).alias("skew"),
        sample_kurtosis(value).alias("kurtosis"),
    )
    return moments.join(quantiles(stacked, "value", PERCENTILES, by=["column"]), "column")


def sign_counts(df: DataFrame) -> DataFrame:
    negative, free = F.col("quantity") < 0, F.col("unit_price") <= 0
    rows = F.count(F.lit(1))
    return df.agg(
        count_if(negative).alias("negative_quantity"),
        (count_if(negative) * 100 / rows).alias("negative_quantity_pct"),
        count_if(F.col("quantity") == 0).alias("zero_quantity"),
        count_if(free).alias("non_positive_price"),
        (count_if(free) * 100 / rows).alias("non_positive_price_pct"),
    )


def top_share(df: DataFrame, value: str, fraction: float) -> DataFrame:
    """Percent of the total held by the largest ``fraction`` of rows."""
    return largest_share(df, value, fraction).select(
        "n_rows", "total", (F.col("top_share") * 100).alias("top_share_pct")
    )


def top_products(lines: DataFrame, top: int = 15) -> DataFrame:
    """Best products by revenue over purchases; a missing description is its own product."""
    return (
        lines.filter(~F.col("is_cancellation"))
        .groupBy("stock_code", "description")
        .agg(
            money_sum(F.col("line_revenue")).alias("revenue"),
            F.sum("quantity").alias("units"),
            F.count_distinct("invoice_no").alias("orders"),
        )
        .orderBy(F.col("revenue").desc(), "stock_code", "description")
        .limit(top)
    )


def largest_orders(lines: DataFrame, top: int = 5) -> DataFrame:
    return (
        lines.groupBy("invoice_no")
        .agg(
            money_sum(F.col("line_revenue")).alias("revenue"),
            F.sum("quantity").alias("quantity"),
            F.count(F.lit(1)).alias("lines"),
            F.min("customer_id").alias("customer"),
        )
        .orderBy(F.col("revenue").desc(), "invoice_no")
        .limit(top)
    )


def largest_quantity(lines: DataFrame, top: int = 5) -> DataFrame:
    shown = [
        "invoice_no", "stock_code", "description", "quantity", "unit_price", "line_revenue",
        "customer_id",
    ]
    order = [F.abs("quantity").desc(), F.col("invoice_no"), F.col("stock_code"),
             F.col("unit_price"), F.col("line_revenue")]
    return lines.select(*shown).orderBy(*order).limit(top)


def country_share(lines: DataFrame) -> DataFrame:
    """Customers, revenue and orders per country, with share and running share in percent."""
    countries = lines.groupBy("country").agg(
        F.count_distinct("customer_id").alias("customers"),
        money_sum(F.col("line_revenue")).alias("revenue"),
        F.count_distinct("invoice_no").alias("orders"),
    )
    whole = lines.agg(money_sum(F.col("line_revenue"))).scalar()
    shared = countries.withColumn("revenue_share_pct", F.round(F.col("revenue") / whole * 100, 2))
    order = [F.col("revenue").desc(), F.col("country")]
    placed = running_totals(shared, order, {"cum_share_pct": F.col("revenue_share_pct")})
    return placed.withColumn("cum_share_pct", F.round("cum_share_pct", 2))


def monthly_trend(lines: DataFrame) -> DataFrame:
    cancelled = count_if(F.col("is_cancellation"))
    return lines.groupBy("invoice_month").agg(
        money_sum(F.col("line_revenue")).alias("net_revenue"),
        F.count_distinct("invoice_no").alias("orders"),
        F.count_distinct("customer_id").alias("customers"),
        cancelled.alias("cancellations"),
        (cancelled * 100 / F.count(F.lit(1))).alias("cancel_rate_pct"),
    )


def customer_summary(lines: DataFrame) -> DataFrame:
    """Orders, lines, revenue, tenure and recency at the end of the data."""
    end = lines.agg(F.max("invoice_date")).scalar()
    return (
        lines.filter(~F.col("is_cancellation"))
        .groupBy("customer_id")
        .agg(
            F.count_distinct("invoice_no").alias("n_orders"),
            F.count(F.lit(1)).alias("n_lines"),
            money_sum(F.col("line_revenue")).alias("total_revenue"),
            F.min("invoice_date").alias("first_purchase"),
            F.max("invoice_date").alias("last_purchase"),
        )
        .withColumn("_end", end)
        .withColumns(
            {
                "aov": F.col("total_revenue") / F.col("n_orders"),
                "tenure_days": elapsed_days(F.col("first_purchase"), F.col("last_purchase")),
                "recency_days": elapsed_days(F.col("last_purchase"), F.col("_end")),
            }
        )
        .drop("_end")
    )


def pareto_curve(customers: DataFrame, value: str = "total_revenue") -> DataFrame:
    """Running share of revenue by customer rank, highest first."""
    # Summed in ten-thousandths: exact, and the same whatever the block borders.
    units = F.floor(F.col(value) * 10_000 + 0.5)
    placed = running_totals(
        customers.select("customer_id", value),
        [F.col(value).desc(), F.col("customer_id")],
        {"rank": F.lit(1).cast("long"), "_upto": units},
        sizes={"_rows": "rank", "_all": "_upto"},
    )
    return placed.select(
        "customer_id",
        "rank",
        (F.col("rank") / F.col("_rows")).alias("customer_share"),
        (F.col("_upto") / F.col("_all")).alias("cumulative_revenue_share"),
    )


def return_rate(lines: DataFrame) -> DataFrame:
    """Percent of lines with negative quantity per customer."""
    negative = count_if(F.col("quantity") < 0)
    return lines.groupBy("customer_id").agg(
        (negative * 100 / F.count(F.lit(1))).alias("return_rate_pct")
    )


def return_rate_summary(lines: DataFrame, threshold: float = 20.0) -> DataFrame:
    above = F.col("return_rate_pct") > threshold
    return return_rate(lines).agg(
        F.count(F.lit(1)).alias("n_customers"),
        count_if(above).alias("n_above"),
        (count_if(above) * 100 / F.count(F.lit(1))).alias("pct_above"),
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Counts in equal bins between the least and the largest value; empty bins are kept."""
    values = df.select(value.cast("double").alias("x")).filter(F.col("x").isNotNull())
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    slot = F.floor(F.try_divide(F.col("x") - F.col("_e.lo"), width))
    counted = (
        values.withColumn("_e", ends)
        .groupBy(F.coalesce(F.least(slot, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(counted, "bin", "left")
        .withColumn("_e", ends)
        .select(
            "bin",
            (F.col("_e.lo") + F.col("bin") * width).alias("lower_edge"),
            (F.col("_e.lo") + (F.col("bin") + 1) * width).alias("upper_edge"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def log_histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Histogram of log1p over the positive values."""
    return histogram(df.filter(F.col(column) > 0), F.log1p(column), bins)


def clipped_histogram(
    df: DataFrame, column: str, lower: float, upper: float, bins: int = 70
) -> DataFrame:
    value = F.greatest(F.least(F.col(column), F.lit(float(upper))), F.lit(float(lower)))
    return histogram(df, F.when(F.col(column).isNotNull(), value), bins)


def layer_counts(raw: DataFrame, clean: DataFrame) -> DataFrame:
    """Headline findings as (metric, value): sizes, losses, concentration and skew."""
    raw_facts = raw.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.col("customer_id").isNull().cast("int")).alias("missing"),
        )
    ).scalar()
    positive = clean.filter(F.col("line_revenue") > 0)
    lead = country_share(clean).agg(F.max("revenue_share_pct")).scalar()
    top_customers = top_share(customer_summary(clean), "total_revenue", 0.2)
    facts = clean.agg(
        F.count(F.lit(1)).alias("clean_rows"),
        F.count_distinct("customer_id").alias("customers"),
        F.count_distinct("country").alias("countries"),
        (F.avg(F.col("is_cancellation").cast("int")) * 100).alias("cancel_rate_pct"),
    ).withColumns(
        {
            "_raw": raw_facts,
            "leading_country_share_pct": lead,
            "top_20_pct_customers_share_pct": top_customers.select("top_share_pct").scalar(),
            "positive_line_revenue_skew": positive.agg(
                sample_skewness(F.col("line_revenue"))
            ).scalar(),
        }
    )
    rows = F.col("_raw.rows")
    metrics = {
        "raw_rows": rows,
        "clean_rows": F.col("clean_rows"),
        "dropped_rows": rows - F.col("clean_rows"),
        "dropped_pct": (rows - F.col("clean_rows")) * 100 / rows,
        "missing_customer_pct": F.col("_raw.missing") * 100,
        "customers": F.col("customers"),
        "countries": F.col("countries"),
        "leading_country_share_pct": F.col("leading_country_share_pct"),
        "cancel_rate_pct": F.col("cancel_rate_pct"),
        "top_20_pct_customers_share_pct": F.col("top_20_pct_customers_share_pct"),
        "positive_line_revenue_skew": F.col("positive_line_revenue_skew"),
    }
    entries = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for name, value in metrics.items()
    ]
    return facts.select(F.inline(F.array(*entries)))
