"""Queries on transaction lines: sources, cleaning, quality reports and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import cleaning, curation, quality
from tideline.plans import stages
from tideline.plans.blocks import BLOCKS, quoted
from tideline.plans.registry import query, r4, when
from tideline.params import NON_PRODUCT_CODES, RESIDUAL_ADMIN_CODES, STOCK_CODE_PATTERN
from tideline.session import new_path
from tideline.sources import loaders, sinks, star_schema

RAW_SHOWN = (
    "invoice_no, stock_code, description, quantity, "
    + when("invoice_date")
    + ", unit_price, customer_id, country, source_sheet"
)
LINE_KEYS = ("invoice_no", "stock_code", "quantity", "unit_price")
KEYS_SQL = ", ".join(LINE_KEYS)


def _path(spark, name: str) -> str:
    return new_path(spark, name)


def _text_lines(spark, sf_dir):
    """Raw lines as a text source gives them; some fields hold text that is no value."""
    unreadable = F.col("description").isNull()
    text = lambda c: F.when(unreadable, "n/a").otherwise(F.col(c).cast("string"))
    return stages.raw(spark, sf_dir).withColumns(
        {c: text(c) for c in ("invoice_date", "quantity", "unit_price", "customer_id")}
    )


@query("load_raw", BLOCKS.sql(f"SELECT {RAW_SHOWN} FROM source_lines", "source_lines"))
def load_raw(spark, sf_dir):
    return loaders.load_raw(star_schema.source_frames(spark, sf_dir))


@query(
    "normalise_headers",
    BLOCKS.sql(
        "SELECT invoice_no, stock_code, description, quantity, "
        + when("invoice_date")
        + ", unit_price, customer_id, country FROM source_lines",
        "source_lines",
    ),
)
def normalise_headers(spark, sf_dir):
    return loaders.normalise_headers(
        star_schema.transaction_lines(spark, sf_dir).drop("_ordered")
    )


@query(
    "cast_identifiers",
    "SELECT CAST(l_orderkey AS VARCHAR) AS invoice_no, CAST(l_partkey AS VARCHAR) AS stock_code, "
    "l_quantity AS quantity FROM lineitem",
)
def cast_identifiers(spark, sf_dir):
    lines = star_schema.read_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice_no"),
        F.col("l_partkey").alias("stock_code"),
        F.col("l_quantity").alias("quantity"),
    )
    return loaders.cast_identifiers(lines)


@query("schema_guard", BLOCKS.sql(f"SELECT {RAW_SHOWN} FROM source_lines", "source_lines"))
def schema_guard(spark, sf_dir):
    widened = stages.raw(spark, sf_dir).withColumn("loaded_from", F.lit("star schema"))
    return loaders.require_columns(widened)


@query(
    "parquet_io",
    BLOCKS.sql(
        "SELECT invoice_month, count(*) AS lines, "
        + r4("round(sum(line_revenue), 4) AS net_revenue")
        + " FROM clean GROUP BY invoice_month",
        "clean",
    ),
)
def parquet_io(spark, sf_dir):
    table = sinks.write_table(
        stages.clean(spark, sf_dir), _path(spark, "transactions"), ["invoice_month"]
    )
    return table.groupBy("invoice_month").agg(
        F.count(F.lit(1)).alias("lines"),
        quality.money_sum(F.col("line_revenue")).alias("net_revenue"),
    )


MONTHLY_SQL = (
    "SELECT invoice_month, count(*) AS n_transaction_lines, "
    "count(DISTINCT invoice_no) AS n_orders, count(DISTINCT customer_id) AS n_customers, "
    "count(*) FILTER (is_cancellation) AS n_cancellations, "
    + r4("round(sum(line_revenue), 4) AS net_revenue")
    + " FROM clean GROUP BY invoice_month"
)


@query("csv_sink", BLOCKS.sql(MONTHLY_SQL, "clean"))
def csv_sink(spark, sf_dir):
    summary = quality.monthly_summary(stages.clean(spark, sf_dir))
    path = _path(spark, "monthly-summary")
    sinks.write_summary(summary, path)
    return sinks.read_summary(spark, path, summary)


@query("json_sink")
def json_sink(spark, sf_dir):
    path = _path(spark, "quality-report")
    sinks.write_report(quality.dq_report(stages.clean(spark, sf_dir), stages.EXPECTED), path)
    return spark.read.text(path)


@query(
    "clean_strings",
    BLOCKS.sql(
        "SELECT trim(invoice_no) AS invoice_no, upper(trim(stock_code)) AS stock_code, "
        "trim(description) AS description, trim(country) AS country FROM source_lines",
        "source_lines",
    ),
)
def clean_strings(spark, sf_dir):
    cleaned = cleaning.clean_strings(stages.raw(spark, sf_dir))
    return cleaned.select("invoice_no", "stock_code", "description", "country")


@query(
    "coerce_timestamp",
    BLOCKS.sql(
        "SELECT invoice_no, strftime(CASE WHEN description IS NOT NULL THEN invoice_date END, "
        "'%Y-%m-%d %H:%M:%S') AS invoice_date FROM source_lines",
        "source_lines",
    ),
)
def coerce_timestamp(spark, sf_dir):
    return cleaning.coerce_timestamp(_text_lines(spark, sf_dir)).select("invoice_no", "invoice_date")


@query(
    "coerce_numeric",
    BLOCKS.sql(
        "SELECT invoice_no, CASE WHEN description IS NOT NULL THEN quantity END AS quantity, "
        "CASE WHEN description IS NOT NULL THEN unit_price END AS unit_price, "
        "CASE WHEN description IS NOT NULL THEN customer_id END AS customer_id FROM source_lines",
        "source_lines",
    ),
)
def coerce_numeric(spark, sf_dir):
    return cleaning.coerce_numeric(_text_lines(spark, sf_dir)).select(
        "invoice_no", "quantity", "unit_price", "customer_id"
    )


@query(
    "drop_unusable",
    BLOCKS.sql(
        f"SELECT {KEYS_SQL} FROM source_lines WHERE description IS NOT NULL", "source_lines"
    ),
)
def drop_unusable(spark, sf_dir):
    typed = cleaning.coerce_numeric(cleaning.coerce_timestamp(_text_lines(spark, sf_dir)))
    return cleaning.drop_unusable(typed).select(*LINE_KEYS)


@query(
    "drop_anonymous",
    BLOCKS.sql(
        f"SELECT {KEYS_SQL}, customer_id FROM source_lines WHERE customer_id IS NOT NULL",
        "source_lines",
    ),
)
def drop_anonymous(spark, sf_dir):
    return cleaning.drop_anonymous(stages.raw(spark, sf_dir)).select(*LINE_KEYS, "customer_id")


@query(
    "flag_cancellation",
    BLOCKS.sql(
        "SELECT invoice_no, starts_with(upper(invoice_no), 'C') AS is_cancellation "
        "FROM source_lines",
        "source_lines",
    ),
)
def flag_cancellation(spark, sf_dir):
    flagged = cleaning.flag_cancellation(stages.raw(spark, sf_dir))
    return flagged.select("invoice_no", "is_cancellation")


@query(
    "flag_return",
    BLOCKS.sql(
        "SELECT invoice_no, quantity, starts_with(upper(invoice_no), 'C') AND quantity < 0 "
        "AS is_return FROM source_lines",
        "source_lines",
    ),
)
def flag_return(spark, sf_dir):
    flagged = cleaning.flag_return(cleaning.flag_cancellation(stages.raw(spark, sf_dir)))
    return flagged.select("invoice_no", "quantity", "is_return")


@query(
    "line_revenue",
    BLOCKS.sql(
        f"SELECT {KEYS_SQL}, {r4('quantity * unit_price AS line_revenue')} FROM source_lines",
        "source_lines",
    ),
)
def line_revenue(spark, sf_dir):
    return cleaning.line_revenue(stages.raw(spark, sf_dir)).select(*LINE_KEYS, "line_revenue")


@query(
    "flag_non_product",
    BLOCKS.sql(
        f"SELECT upper(trim(stock_code)) AS stock_code, upper(trim(stock_code)) IN "
        f"({quoted(NON_PRODUCT_CODES)}) AS is_non_product FROM source_lines",
        "source_lines",
    ),
)
def flag_non_product(spark, sf_dir):
    flagged = cleaning.flag_non_product(cleaning.clean_strings(stages.raw(spark, sf_dir)))
    return flagged.select("stock_code", "is_non_product")


@query(
    "drop_non_product",
    BLOCKS.sql(
        f"SELECT invoice_no, upper(trim(stock_code)) AS stock_code FROM source_lines "
        f"WHERE upper(trim(stock_code)) NOT IN ({quoted(NON_PRODUCT_CODES)})",
        "source_lines",
    ),
)
def drop_non_product(spark, sf_dir):
    flagged = cleaning.flag_non_product(cleaning.clean_strings(stages.raw(spark, sf_dir)))
    return cleaning.drop_non_product(flagged).select("invoice_no", "stock_code")


@query("dedup_lines", BLOCKS.sql(f"SELECT DISTINCT {RAW_SHOWN} FROM source_lines", "source_lines"))
def dedup_lines(spark, sf_dir):
    lines = stages.raw(spark, sf_dir)
    return cleaning.dedup_lines(lines.unionByName(lines))


@query(
    "invoice_month",
    BLOCKS.sql(
        "SELECT invoice_no, strftime(invoice_date, '%Y-%m') AS invoice_month FROM source_lines",
        "source_lines",
    ),
)
def invoice_month(spark, sf_dir):
    return cleaning.invoice_month(stages.raw(spark, sf_dir)).select("invoice_no", "invoice_month")


CLEAN_SHOWN = (
    RAW_SHOWN
    + ", is_cancellation, is_return, is_non_product, invoice_month, "
    + r4("line_revenue")
)


@query("clean_transactions", BLOCKS.sql(f"SELECT {CLEAN_SHOWN} FROM clean", "clean"))
def clean_transactions(spark, sf_dir):
    return cleaning.clean_transactions(stages.raw(spark, sf_dir))


QUALITY_FACTS = (
    "count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, "
    "count(DISTINCT invoice_no) AS n_invoices, count(DISTINCT stock_code) AS n_products, "
    "count(DISTINCT country) AS n_countries, "
    "count(*) FILTER (is_cancellation) AS n_cancellations, "
    + r4(
        "round(sum(line_revenue), 2) AS total_net_revenue",
        "round(sum(line_revenue) FILTER (NOT is_cancellation), 2) AS gross_revenue",
    )
    + ", strftime(min(invoice_date), '%Y-%m-%d %H:%M:%S') AS invoice_date_min, "
    "strftime(max(invoice_date), '%Y-%m-%d %H:%M:%S') AS invoice_date_max, "
    "count(*) > 0 AND count(customer_id) = count(*) AND count(invoice_date) = count(*) AS passed"
)


@query("dq_report", BLOCKS.sql(f"SELECT {QUALITY_FACTS} FROM clean", "clean"))
def dq_report(spark, sf_dir):
    return quality.dq_report(stages.clean(spark, sf_dir), stages.EXPECTED).drop("issues")


@query(
    "dq_issues",
    BLOCKS.sql(
        f"""
    SELECT level, message FROM (
      SELECT 'error' AS level, 'Cleaned transactions dataset is empty' AS message,
             count(*) = 0 AS found FROM clean
      UNION ALL SELECT 'error', 'Null customer_id values present after cleaning',
             count(*) > count(customer_id) FROM clean
      UNION ALL SELECT 'error', 'Null invoice_date values present after cleaning',
             count(*) > count(invoice_date) FROM clean
      UNION ALL SELECT 'warning', 'Fewer than two unique customers in the dataset',
             count(*) > 0 AND count(DISTINCT customer_id) < 2 FROM clean
      UNION ALL SELECT 'warning', 'Earliest invoice ' || CAST(min(invoice_date) AS DATE)
               || ' precedes {stages.EXPECTED.min_invoice_date}',
             min(invoice_date) < TIMESTAMP '{stages.EXPECTED.min_invoice_date}' FROM clean
      UNION ALL SELECT 'warning', 'Latest invoice ' || CAST(max(invoice_date) AS DATE)
               || ' is after {stages.EXPECTED.max_invoice_date}',
             max(invoice_date) > TIMESTAMP '{stages.EXPECTED.max_invoice_date}' FROM clean)
    WHERE found""",
        "clean",
    ),
)
def dq_issues(spark, sf_dir):
    return quality.explode_issues(
        quality.dq_report(stages.clean(spark, sf_dir), stages.EXPECTED)
    )


@query("monthly_summary", BLOCKS.sql(MONTHLY_SQL, "clean"))
def monthly_summary(spark, sf_dir):
    return quality.monthly_summary(stages.clean(spark, sf_dir))


@query(
    "curated_dq_report",
    BLOCKS.sql(
        f"""
    SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers,
           count(*) FILTER (is_zero_price) AS n_zero_price_lines,
           count(*) FILTER (is_outlier) AS n_outliers_capped,
           count(*) FILTER (is_cancellation) AS n_returns,
           count(DISTINCT country) AS n_countries,
           count(DISTINCT country_grouped) AS n_countries_grouped,
           {r4("round(sum(line_revenue_gross), 2) AS gross_revenue",
               "round(sum(line_revenue), 2) AS net_revenue")},
           count(*) > 0 AND count(*) FILTER (NOT regexp_matches(stock_code,
             '{STOCK_CODE_PATTERN}') OR unit_price < 0 OR line_revenue IS NULL) = 0 AS passed
    FROM curated""",
        "curated",
    ),
)
def curated_dq_report(spark, sf_dir):
    return quality.curated_dq_report(stages.curated(spark, sf_dir)).drop("issues")


@query(
    "curated_dq_issues",
    BLOCKS.sql(
        f"""
    SELECT level, message FROM (
      SELECT 'error' AS level, bad || ' stock codes fail format {STOCK_CODE_PATTERN}: ' || codes
             AS message, bad > 0 AS found
      FROM (SELECT count(*) AS bad FROM clean
            WHERE NOT regexp_matches(stock_code, '{STOCK_CODE_PATTERN}')),
           (SELECT '[''' || string_agg(stock_code, ''', ''' ORDER BY stock_code) || ''']' AS codes
            FROM (SELECT DISTINCT stock_code FROM clean
                  WHERE NOT regexp_matches(stock_code, '{STOCK_CODE_PATTERN}')
                  ORDER BY stock_code LIMIT 5))
      UNION ALL
      SELECT 'error', count(*) || ' rows have negative unit_price', count(*) > 0
      FROM clean WHERE unit_price < 0
      UNION ALL
      SELECT 'info', count(*) || ' zero-price lines flagged and excluded from monetary features',
             count(*) > 0
      FROM clean WHERE unit_price <= 0) WHERE found""",
        "clean",
    ),
)
def curated_dq_issues(spark, sf_dir):
    # Without the residual codes removed, so that the code format has something to find.
    kept_codes = stages.replace(stages.CURATION, residual_admin_codes=("TEST001",))
    lines = curation.curate_transactions(stages.clean(spark, sf_dir), kept_codes)
    return quality.explode_issues(quality.curated_dq_report(lines))


@query(
    "drop_residual_admin",
    BLOCKS.sql(
        f"SELECT {KEYS_SQL} FROM clean WHERE stock_code NOT IN ({quoted(RESIDUAL_ADMIN_CODES)})",
        "clean",
    ),
)
def drop_residual_admin(spark, sf_dir):
    return curation.drop_residual_admin(stages.clean(spark, sf_dir)).select(*LINE_KEYS)


@query(
    "flag_zero_price",
    BLOCKS.sql("SELECT invoice_no, unit_price, unit_price <= 0 AS is_zero_price FROM clean", "clean"),
)
def flag_zero_price(spark, sf_dir):
    flagged = curation.flag_zero_price(stages.clean(spark, sf_dir))
    return flagged.select("invoice_no", "unit_price", "is_zero_price")


@query(
    "flag_monetary_eligible",
    BLOCKS.sql(
        "SELECT invoice_no, unit_price, NOT is_cancellation AND unit_price > 0 "
        "AS is_monetary_eligible FROM clean",
        "clean",
    ),
)
def flag_monetary_eligible(spark, sf_dir):
    flagged = curation.flag_zero_price(stages.clean(spark, sf_dir))
    return curation.flag_monetary_eligible(flagged).select(
        "invoice_no", "unit_price", "is_monetary_eligible"
    )


@query(
    "gross_revenue_line",
    BLOCKS.sql(
        "SELECT invoice_no, "
        + r4("CASE WHEN is_cancellation THEN 0 ELSE line_revenue END AS line_revenue_gross")
        + " FROM clean",
        "clean",
    ),
)
def gross_revenue_line(spark, sf_dir):
    lines = curation.gross_revenue_line(stages.clean(spark, sf_dir))
    return lines.select("invoice_no", "line_revenue_gross")


@query(
    "return_value_line",
    BLOCKS.sql(
        "SELECT invoice_no, "
        + r4("CASE WHEN is_cancellation THEN -line_revenue ELSE 0 END AS return_value")
        + " FROM clean",
        "clean",
    ),
)
def return_value_line(spark, sf_dir):
    lines = curation.return_value_line(stages.clean(spark, sf_dir))
    return lines.select("invoice_no", "return_value")


@query(
    "winsorise",
    BLOCKS.sql(
        f"SELECT {KEYS_SQL}, {r4('quantity_winsorised', 'line_revenue_winsorised')} FROM curated",
        "curated",
    ),
)
def winsorise(spark, sf_dir):
    kept = curation.drop_residual_admin(stages.clean(spark, sf_dir))
    return curation.winsorise(kept).select(
        *LINE_KEYS, "quantity_winsorised", "line_revenue_winsorised"
    )


@query(
    "flag_outlier",
    BLOCKS.sql(
        f"SELECT {KEYS_SQL}, quantity_is_outlier, line_revenue_is_outlier, is_outlier FROM curated",
        "curated",
    ),
)
def flag_outlier(spark, sf_dir):
    kept = curation.drop_residual_admin(stages.clean(spark, sf_dir))
    return curation.flag_outlier(curation.winsorise(kept)).select(
        *LINE_KEYS, "quantity_is_outlier", "line_revenue_is_outlier", "is_outlier"
    )


@query(
    "country_grouping",
    BLOCKS.sql("SELECT invoice_no, country, country_grouped FROM slim", "slim"),
)
def country_grouping(spark, sf_dir):
    kept = curation.drop_residual_admin(stages.clean(spark, sf_dir))
    return curation.country_grouping(kept, stages.CURATION).select(
        "invoice_no", "country", "country_grouped"
    )


@query(
    "curate_transactions",
    BLOCKS.sql(
        f"""SELECT {CLEAN_SHOWN}, is_zero_price, is_monetary_eligible, country_grouped,
            quantity_is_outlier, line_revenue_is_outlier, is_outlier,
            {r4("line_revenue_gross", "return_value", "quantity_winsorised",
                "line_revenue_winsorised")} FROM curated""",
        "curated",
    ),
)
def curate_transactions(spark, sf_dir):
    return stages.curated(spark, sf_dir)
