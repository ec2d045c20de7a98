"""Queries of the exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import exploration as ops
from tideline.plans import stages
from tideline.plans.blocks import BLOCKS
from tideline.plans.registry import query, r4, when

BLOCKS.add(
    "raw_lines",
    """SELECT *, starts_with(upper(invoice_no), 'C') AS is_cancellation,
       quantity * unit_price AS line_revenue, strftime(invoice_date, '%Y-%m') AS invoice_month,
       customer_id IS NULL AS missing_customer FROM source_lines""",
    ["source_lines"],
)
RAW_TYPES = {
    "invoice_no": "string",
    "stock_code": "string",
    "description": "string",
    "quantity": "double",
    "invoice_date": "timestamp_ntz",
    "unit_price": "double",
    "customer_id": "bigint",
    "country": "string",
    "source_sheet": "string",
}


def raw_lines(spark, sf_dir):
    return ops.with_helper_columns(stages.raw(spark, sf_dir))


@query(
    "column_profile",
    BLOCKS.sql(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS "column", '{t}' AS dtype, count(DISTINCT {c}) AS n_unique,
                count(*) - count({c}) AS n_missing,
                {r4(f"round((1 - count({c}) / count(*)) * 100, 2) AS pct_missing")}
                FROM source_lines"""
            for c, t in RAW_TYPES.items()
        ),
        "source_lines",
    ),
)
def column_profile(spark, sf_dir):
    return ops.column_profile(stages.raw(spark, sf_dir))


MISSING = (
    "count(*) AS n_rows, count(*) FILTER (missing_customer) AS n_missing, "
    + r4("100 * count(*) FILTER (missing_customer) / count(*) AS pct_missing")
)


@query(
    "missing_by_group",
    BLOCKS.sql(
        f"""SELECT 'country' AS kind, country AS value, {MISSING} FROM raw_lines GROUP BY country
            UNION ALL
            SELECT 'month', invoice_month, {MISSING} FROM raw_lines GROUP BY invoice_month""",
        "raw_lines",
    ),
)
def missing_by_group(spark, sf_dir):
    lines = raw_lines(spark, sf_dir)
    parts = [
        ops.missing_by_group(lines, column).select(
            F.lit(kind).alias("kind"), F.col(column).alias("value"), "n_rows", "n_missing",
            "pct_missing",
        )
        for kind, column in (("country", "country"), ("month", "invoice_month"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "chi_square_assoc",
    BLOCKS.sql(
        f"""
    SELECT CAST((k - 1) * (m - 1) AS BIGINT) AS dof, CAST(n AS BIGINT) AS n,
           {r4("chi2", "sqrt(chi2 / (n * (least(k, m) - 1))) AS cramers_v")}
    FROM (SELECT sum(pow(coalesce(o, 0) - r * c / n, 2) / (r * c / n)) AS chi2,
                 count(DISTINCT country) AS k, count(DISTINCT missing_customer) AS m,
                 max(n) AS n
          FROM (SELECT country, CAST(count(*) AS DOUBLE) AS r FROM raw_lines GROUP BY country)
          CROSS JOIN (SELECT missing_customer, CAST(count(*) AS DOUBLE) AS c FROM raw_lines
                      GROUP BY missing_customer)
          CROSS JOIN (SELECT CAST(count(*) AS DOUBLE) AS n FROM raw_lines)
          LEFT JOIN (SELECT country, missing_customer, count(*) AS o FROM raw_lines GROUP BY ALL)
            USING (country, missing_customer))""",
        "raw_lines",
    ),
)
def chi_square_assoc(spark, sf_dir):
    found = ops.chi_square_assoc(raw_lines(spark, sf_dir), "country", "missing_customer")
    return found.drop("p_value")


@query(
    "mann_whitney",
    BLOCKS.sql(
        f"""
    SELECT {r4("n1 AS n_first", "n2 AS n_second", "u AS u_statistic",
        "(abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties "
        "/ ((n1 + n2) * (n1 + n2 - 1)))) AS z")}
    FROM (SELECT n1, n2, ties, ranks - n1 * (n1 + 1) / 2 AS u
          FROM (SELECT CAST(count(*) FILTER (missing_customer) AS DOUBLE) AS n1,
                       CAST(count(*) FILTER (NOT missing_customer) AS DOUBLE) AS n2,
                       sum(place) FILTER (missing_customer) AS ranks
                FROM (SELECT missing_customer, rank() OVER (ORDER BY line_revenue)
                        + (count(*) OVER (PARTITION BY line_revenue) - 1) / 2.0::DOUBLE AS place
                      FROM raw_lines)),
               (SELECT sum(t * t * t - t) AS ties
                FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM raw_lines GROUP BY line_revenue)))
    """,
        "raw_lines",
    ),
)
def mann_whitney(spark, sf_dir):
    found = ops.mann_whitney(raw_lines(spark, sf_dir), "line_revenue", F.col("missing_customer"))
    return found.drop("p_value")


@query(
    "group_behaviour",
    BLOCKS.sql(
        f"""
    SELECT missing_customer, count(*) AS n_rows, {r4(
        "avg(is_cancellation::INT) AS cancellation_rate",
        "avg((line_revenue < 0)::INT) AS negative_line_rate",
        "round(sum(line_revenue), 4) / count(*) AS mean_line_revenue",
        "avg(quantity) AS mean_quantity", "median(line_revenue) AS median_line_revenue",
        "median(unit_price) AS median_unit_price")}
    FROM raw_lines GROUP BY missing_customer""",
        "raw_lines",
    ),
)
def group_behaviour(spark, sf_dir):
    return ops.group_behaviour(stages.materialise(raw_lines(spark, sf_dir)))


@query(
    "missing_description",
    BLOCKS.sql(
        f"""
    SELECT count(*) FILTER (description IS NULL) AS n_missing,
           count(DISTINCT stock_code) FILTER (description IS NULL) AS n_codes, {r4(
        "100 * count(*) FILTER (description IS NULL) / count(*) AS pct_missing",
        "avg(is_cancellation::INT) FILTER (description IS NULL) AS cancel_rate_missing",
        "avg(is_cancellation::INT) FILTER (description IS NOT NULL) AS cancel_rate_present",
        "avg(quantity) FILTER (description IS NULL) AS mean_quantity_missing",
        "avg(quantity) FILTER (description IS NOT NULL) AS mean_quantity_present",
        "100 * (SELECT sum(n) FROM (SELECT count(*) AS n FROM raw_lines WHERE description IS NULL "
        "GROUP BY stock_code ORDER BY n DESC LIMIT 10)) "
        "/ count(*) FILTER (description IS NULL) AS top_codes_share")}
    FROM raw_lines""",
        "raw_lines",
    ),
)
def missing_description(spark, sf_dir):
    return ops.missing_description(raw_lines(spark, sf_dir))


@query(
    "missing_description_codes",
    BLOCKS.sql(
        "SELECT stock_code, count(*) AS n_lines FROM raw_lines WHERE description IS NULL "
        "GROUP BY stock_code ORDER BY n_lines DESC, stock_code LIMIT 10",
        "raw_lines",
    ),
)
def missing_description_codes(spark, sf_dir):
    return ops.missing_description_codes(raw_lines(spark, sf_dir))


def _describe(source: str, columns) -> str:
    percentiles = ", ".join(f"quantile_cont(v, {p}) AS {n}" for n, p in ops.PERCENTILES.items())
    inner = " UNION ALL ".join(
        f"""SELECT '{c}' AS name, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS lo,
            max(v) AS hi, skewness(v) AS skew, kurtosis(v) AS kurtosis, {percentiles}
            FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source})"""
        for c in columns
    )
    return (
        "SELECT name AS \"column\", n AS \"count\", "
        + r4("mean", "std", "lo AS min", "hi AS max", "skew", "kurtosis", *ops.PERCENTILES)
        + f" FROM ({inner})"
    )


LINE_NUMBERS = ["quantity", "unit_price", "line_revenue"]


@query("describe_numeric", BLOCKS.sql(_describe("clean", LINE_NUMBERS), "clean"))
def describe_numeric(spark, sf_dir):
    return ops.describe_numeric(stages.clean(spark, sf_dir), LINE_NUMBERS)


BLOCKS.add(
    "shoppers",
    """
    SELECT *, total_revenue / n_orders AS aov,
           date_sub('day', first_purchase, last_purchase) AS tenure_days,
           date_sub('day', last_purchase, (SELECT max(invoice_date) FROM clean)) AS recency_days
    FROM (SELECT customer_id, count(DISTINCT invoice_no) AS n_orders, count(*) AS n_lines,
                 round(sum(line_revenue), 4) AS total_revenue, min(invoice_date) AS first_purchase,
                 max(invoice_date) AS last_purchase
          FROM clean WHERE NOT is_cancellation GROUP BY customer_id)""",
    ["clean"],
)
SHOPPER_NUMBERS = ["n_orders", "total_revenue", "aov", "recency_days", "tenure_days"]


@query("describe_customers", BLOCKS.sql(_describe("shoppers", SHOPPER_NUMBERS), "shoppers"))
def describe_customers(spark, sf_dir):
    customers = stages.materialise(ops.customer_summary(stages.clean(spark, sf_dir)))
    return ops.describe_numeric(customers, SHOPPER_NUMBERS)


@query(
    "sign_counts",
    BLOCKS.sql(
        f"""
    SELECT count(*) FILTER (quantity < 0) AS negative_quantity,
           count(*) FILTER (quantity = 0) AS zero_quantity,
           count(*) FILTER (unit_price <= 0) AS non_positive_price, {r4(
        "100 * count(*) FILTER (quantity < 0) / count(*) AS negative_quantity_pct",
        "100 * count(*) FILTER (unit_price <= 0) / count(*) AS non_positive_price_pct")}
    FROM clean""",
        "clean",
    ),
)
def sign_counts(spark, sf_dir):
    return ops.sign_counts(stages.clean(spark, sf_dir))


def _share(source: str, column: str, fraction: float) -> str:
    return f"""
    SELECT CAST(max(n) AS BIGINT) AS n_rows, {r4(
        "round(sum(v), 2) AS total",
        f"100 * sum(v) FILTER (place <= greatest(1, floor(n * {fraction}::DOUBLE))) / sum(v) "
        "AS top_share_pct")}
    FROM (SELECT v, row_number() OVER (ORDER BY v DESC) AS place, count(*) OVER () AS n
          FROM (SELECT {column} AS v FROM {source}))"""


@query(
    "top_share",
    BLOCKS.sql(
        _share("(SELECT * FROM clean WHERE line_revenue > 0)", "line_revenue", 0.01), "clean"
    ),
)
def top_share(spark, sf_dir):
    positive = stages.clean(spark, sf_dir).filter("line_revenue > 0")
    return ops.top_share(positive, "line_revenue", 0.01).withColumn("total", F.round("total", 2))


@query("top_customer_share", BLOCKS.sql(_share("shoppers", "total_revenue", 0.2), "shoppers"))
def top_customer_share(spark, sf_dir):
    customers = ops.customer_summary(stages.clean(spark, sf_dir))
    return ops.top_share(customers, "total_revenue", 0.2).withColumn("total", F.round("total", 2))


@query(
    "top_products",
    BLOCKS.sql(
        f"""
    SELECT stock_code, description, orders, {r4("revenue", "units")}
    FROM (SELECT stock_code, description, round(sum(line_revenue), 4) AS revenue,
                 sum(quantity) AS units, count(DISTINCT invoice_no) AS orders
          FROM clean WHERE NOT is_cancellation GROUP BY stock_code, description)
    ORDER BY revenue DESC, stock_code LIMIT 15""",
        "clean",
    ),
)
def top_products(spark, sf_dir):
    return ops.top_products(stages.clean(spark, sf_dir))


@query(
    "largest_orders",
    BLOCKS.sql(
        f"""
    SELECT invoice_no, lines, customer, {r4("revenue", "quantity")}
    FROM (SELECT invoice_no, round(sum(line_revenue), 4) AS revenue, sum(quantity) AS quantity,
                 count(*) AS lines, min(customer_id) AS customer FROM clean GROUP BY invoice_no)
    ORDER BY revenue DESC, invoice_no LIMIT 5""",
        "clean",
    ),
)
def largest_orders(spark, sf_dir):
    return ops.largest_orders(stages.clean(spark, sf_dir))


@query(
    "largest_quantity",
    BLOCKS.sql(
        f"""
    SELECT invoice_no, stock_code, description, customer_id,
           {r4("quantity", "unit_price", "line_revenue")}
    FROM (SELECT * FROM clean ORDER BY abs(quantity) DESC, invoice_no, stock_code, unit_price,
                 line_revenue LIMIT 5)""",
        "clean",
    ),
)
def largest_quantity(spark, sf_dir):
    return ops.largest_quantity(stages.clean(spark, sf_dir))


@query(
    "country_share",
    BLOCKS.sql(
        f"""
    SELECT country, customers, orders, {r4("revenue", "share AS revenue_share_pct",
        "round(sum(share) OVER (ORDER BY revenue DESC, country), 2) AS cum_share_pct")}
    FROM (SELECT country, count(DISTINCT customer_id) AS customers,
                 count(DISTINCT invoice_no) AS orders, round(sum(line_revenue), 4) AS revenue,
                 round(round(sum(line_revenue), 4)
                       / (SELECT round(sum(line_revenue), 4) FROM clean) * 100, 2) AS share
          FROM clean GROUP BY country)""",
        "clean",
    ),
)
def country_share(spark, sf_dir):
    return ops.country_share(stages.clean(spark, sf_dir))


@query(
    "monthly_trend",
    BLOCKS.sql(
        f"""
    SELECT invoice_month, count(DISTINCT invoice_no) AS orders,
           count(DISTINCT customer_id) AS customers,
           count(*) FILTER (is_cancellation) AS cancellations, {r4(
        "round(sum(line_revenue), 4) AS net_revenue",
        "100 * count(*) FILTER (is_cancellation) / count(*) AS cancel_rate_pct")}
    FROM clean GROUP BY invoice_month""",
        "clean",
    ),
)
def monthly_trend(spark, sf_dir):
    return ops.monthly_trend(stages.clean(spark, sf_dir))


@query(
    "customer_summary",
    BLOCKS.sql(
        f"""SELECT customer_id, n_orders, n_lines, CAST(tenure_days AS BIGINT) AS tenure_days,
            CAST(recency_days AS BIGINT) AS recency_days, {when("first_purchase")},
            {when("last_purchase")}, {r4("total_revenue", "aov")} FROM shoppers""",
        "shoppers",
    ),
)
def customer_summary(spark, sf_dir):
    return ops.customer_summary(stages.clean(spark, sf_dir))


@query(
    "pareto_curve",
    BLOCKS.sql(
        f"""
    SELECT customer_id, place AS rank, {r4("place / n AS customer_share",
        "upto / total AS cumulative_revenue_share")}
    FROM (SELECT customer_id, row_number() OVER w AS place, count(*) OVER () AS n,
                 sum(total_revenue) OVER w AS upto, sum(total_revenue) OVER () AS total
          FROM shoppers WINDOW w AS (ORDER BY total_revenue DESC, customer_id))""",
        "shoppers",
    ),
)
def pareto_curve(spark, sf_dir):
    return ops.pareto_curve(ops.customer_summary(stages.clean(spark, sf_dir)))


BLOCKS.add(
    "return_rates",
    """SELECT customer_id, 100 * count(*) FILTER (quantity < 0) / count(*) AS return_rate_pct
       FROM clean GROUP BY customer_id""",
    ["clean"],
)


@query(
    "return_rate",
    BLOCKS.sql(f"SELECT customer_id, {r4('return_rate_pct')} FROM return_rates", "return_rates"),
)
def return_rate(spark, sf_dir):
    return ops.return_rate(stages.clean(spark, sf_dir))


@query(
    "return_rate_summary",
    BLOCKS.sql(
        f"""SELECT count(*) AS n_customers, count(*) FILTER (return_rate_pct > 20) AS n_above,
            {r4("100 * count(*) FILTER (return_rate_pct > 20) / count(*) AS pct_above")}
            FROM return_rates""",
        "return_rates",
    ),
)
def return_rate_summary(spark, sf_dir):
    return ops.return_rate_summary(stages.clean(spark, sf_dir))


def _histogram(values: str, bins: int) -> str:
    return f"""
    SELECT CAST(bin AS BIGINT) AS bin, count(x) AS n, {r4(
        "lo + bin * (hi - lo) / {b} AS lower_edge".format(b=bins),
        "lo + (bin + 1) * (hi - lo) / {b} AS upper_edge".format(b=bins))}
    FROM (SELECT min(x) AS lo, max(x) AS hi FROM ({values}))
    CROSS JOIN range({bins}) AS every(bin)
    LEFT JOIN (SELECT x, least(floor((x - a) / ((b - a) / {bins})), {bins - 1}) AS slot
               FROM ({values}), (SELECT min(x) AS a, max(x) AS b FROM ({values}))) ON slot = bin
    GROUP BY bin, lo, hi"""


LOG_REVENUE = "SELECT ln(1 + line_revenue) AS x FROM clean WHERE line_revenue > 0"


@query("log_histogram", BLOCKS.sql(_histogram(LOG_REVENUE, 80), "clean"))
def log_histogram(spark, sf_dir):
    return ops.log_histogram(stages.clean(spark, sf_dir), "line_revenue", 80)


CLIPPED_PRICE = "SELECT least(greatest(unit_price, 0), 5000) AS x FROM clean"


@query("clipped_histogram", BLOCKS.sql(_histogram(CLIPPED_PRICE, 70), "clean"))
def clipped_histogram(spark, sf_dir):
    return ops.clipped_histogram(stages.clean(spark, sf_dir), "unit_price", 0, 5000, 70)


@query(
    "layer_counts",
    BLOCKS.sql(
        f"""
    SELECT metric, {r4("value")} FROM (
      SELECT 'raw_rows' AS metric, CAST(count(*) AS DOUBLE) AS value FROM source_lines
      UNION ALL SELECT 'clean_rows', count(*) FROM clean
      UNION ALL SELECT 'dropped_rows', (SELECT count(*) FROM source_lines) - count(*) FROM clean
      UNION ALL SELECT 'dropped_pct', 100 * ((SELECT count(*) FROM source_lines) - count(*))
                       / (SELECT count(*) FROM source_lines) FROM clean
      UNION ALL SELECT 'missing_customer_pct', avg((customer_id IS NULL)::INT) * 100
                FROM source_lines
      UNION ALL SELECT 'customers', count(DISTINCT customer_id) FROM clean
      UNION ALL SELECT 'countries', count(DISTINCT country) FROM clean
      UNION ALL SELECT 'leading_country_share_pct', max(share) FROM (
                SELECT round(round(sum(line_revenue), 4)
                             / (SELECT round(sum(line_revenue), 4) FROM clean) * 100, 2) AS share
                FROM clean GROUP BY country)
      UNION ALL SELECT 'cancel_rate_pct', avg(is_cancellation::INT) * 100 FROM clean
      UNION ALL SELECT 'positive_line_revenue_skew', skewness(line_revenue) FROM clean
                WHERE line_revenue > 0
      UNION ALL SELECT 'top_20_pct_customers_share_pct',
                100 * sum(v) FILTER (place <= greatest(1, floor(n * 0.2::DOUBLE))) / sum(v)
                FROM (SELECT total_revenue AS v, count(*) OVER () AS n,
                             row_number() OVER (ORDER BY total_revenue DESC) AS place
                      FROM shoppers))""",
        "source_lines",
        "clean",
        "shoppers",
    ),
)
def layer_counts(spark, sf_dir):
    return ops.layer_counts(stages.raw(spark, sf_dir), stages.clean(spark, sf_dir))
