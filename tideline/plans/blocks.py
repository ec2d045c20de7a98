"""SQL building blocks of the oracle: the stages written as plain queries."""

from __future__ import annotations

from tideline.plans import stages
from tideline.plans.registry import Blocks
from tideline.params import NON_PRODUCT_CODES, RESIDUAL_ADMIN_CODES

BLOCKS = Blocks()


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


BLOCKS.add(
    "source_lines",
    """
    SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE '' END
             || CAST(o_orderkey AS VARCHAR) AS invoice_no,
           CASE WHEN l_partkey % 89 = 0 THEN ' post ' WHEN l_partkey % 97 = 0 THEN 'ADJUST'
                WHEN l_partkey < 100000 THEN lpad(CAST(l_partkey AS VARCHAR), 5, '0')
                ELSE CAST(l_partkey AS VARCHAR) END AS stock_code,
           CASE WHEN l_partkey % 50 <> 0 THEN p_name END AS description,
           CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F'
                THEN -l_quantity ELSE l_quantity END AS quantity,
           o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS invoice_date,
           CASE WHEN l_partkey % 101 = 0 THEN 0.0::DOUBLE
                ELSE floor(l_extendedprice * (1 - l_discount) / l_quantity * 100 + 0.5)
                     / 100.0::DOUBLE END AS unit_price,
           CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS customer_id,
           n_name AS country,
           CASE WHEN o_orderdate < TIMESTAMP '1998-07-01' THEN 'first' ELSE 'second' END
             AS source_sheet
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN part ON l_partkey = p_partkey""",
)
BLOCKS.add(
    "clean",
    f"""
    SELECT DISTINCT invoice_no, stock_code, description, quantity, invoice_date, unit_price,
           customer_id, country, source_sheet,
           upper(invoice_no) LIKE 'C%' AS is_cancellation,
           upper(invoice_no) LIKE 'C%' AND quantity < 0 AS is_return,
           quantity * unit_price AS line_revenue, false AS is_non_product,
           strftime(invoice_date, '%Y-%m') AS invoice_month
    FROM (SELECT trim(invoice_no) AS invoice_no, upper(trim(stock_code)) AS stock_code,
                 trim(description) AS description, quantity, invoice_date, unit_price,
                 customer_id, trim(country) AS country, source_sheet FROM source_lines)
    WHERE customer_id IS NOT NULL AND stock_code NOT IN ({quoted(NON_PRODUCT_CODES)})""",
    ["source_lines"],
)
BLOCKS.add(
    "kept",
    f"SELECT * FROM clean WHERE stock_code NOT IN ({quoted(RESIDUAL_ADMIN_CODES)})",
    ["clean"],
)
BLOCKS.add(
    "caps",
    """
    SELECT quantile_cont(quantity, 0.001) AS q_lo, quantile_cont(quantity, 0.999) AS q_hi,
           quantile_cont(line_revenue, 0.001) AS r_lo, quantile_cont(line_revenue, 0.999) AS r_hi
    FROM kept""",
    ["kept"],
)
BLOCKS.add(
    "frequent",
    "SELECT country AS frequent_country FROM kept GROUP BY country "
    f"HAVING count(*) >= {stages.MIN_COUNTRY_LINES}",
    ["kept"],
)
BLOCKS.add(
    "curated",
    """
    SELECT *, quantity <> quantity_winsorised AS quantity_is_outlier,
           line_revenue <> line_revenue_winsorised AS line_revenue_is_outlier,
           quantity <> quantity_winsorised OR line_revenue <> line_revenue_winsorised AS is_outlier
    FROM (SELECT kept.*, unit_price <= 0 AS is_zero_price,
                 NOT is_cancellation AND unit_price > 0 AS is_monetary_eligible,
                 CASE WHEN is_cancellation THEN 0.0 ELSE line_revenue END AS line_revenue_gross,
                 CASE WHEN is_cancellation THEN -line_revenue ELSE 0.0 END AS return_value,
                 least(greatest(quantity, q_lo), q_hi) AS quantity_winsorised,
                 least(greatest(line_revenue, r_lo), r_hi) AS line_revenue_winsorised,
                 coalesce(frequent_country, 'Other') AS country_grouped
          FROM kept CROSS JOIN caps LEFT JOIN frequent ON country = frequent_country)""",
    ["kept", "caps", "frequent"],
)
BLOCKS.add(
    "slim",
    """
    SELECT kept.*, CASE WHEN is_cancellation THEN -line_revenue ELSE 0.0 END AS return_value,
           coalesce(frequent_country, 'Other') AS country_grouped
    FROM kept LEFT JOIN frequent ON country = frequent_country""",
    ["kept", "frequent"],
)


def add_feature_blocks(prefix: str, dates) -> None:
    """Features and labels at the given cutoffs, under names starting with ``prefix``."""
    p = prefix
    values = ", ".join(f"(TIMESTAMP '{d}')" for d in dates)
    BLOCKS.add(f"{p}cohorts", f"SELECT * FROM (VALUES {values}) AS t(cohort_date)")
    BLOCKS.add(
        f"{p}seen",
        f"""SELECT c.cohort_date, s.* FROM slim s JOIN {p}cohorts c
            ON s.invoice_date <= c.cohort_date""",
        ["slim", f"{p}cohorts"],
    )
    BLOCKS.add(
        f"{p}order_facts",
        f"""
        SELECT cohort_date, customer_id, invoice_no, min(invoice_date) AS order_date,
               round(sum(line_revenue), 4) AS order_revenue, count(*) AS order_lines,
               sum(quantity) AS order_quantity
        FROM {p}seen WHERE NOT is_cancellation GROUP BY ALL""",
        [f"{p}seen"],
    )
    windows = ", ".join(
        f"count(*) FILTER (order_date > cohort_date - INTERVAL {w} DAY) AS n_orders_{w}, "
        f"coalesce(round(sum(order_revenue) FILTER "
        f"(order_date > cohort_date - INTERVAL {w} DAY), 4), 0) AS revenue_{w}"
        for w in stages.TEMPORAL.recent_windows
    )
    previous = (
        "order_date > cohort_date - INTERVAL 180 DAY AND order_date <= cohort_date - INTERVAL 90 DAY"
    )
    BLOCKS.add(
        f"{p}core",
        f"""
        SELECT cohort_date, customer_id, count(DISTINCT invoice_no) AS n_orders,
               round(sum(order_revenue), 4) AS gross_revenue,
               round(sum(order_revenue), 4) / count(*) AS aov,
               median(order_revenue) AS median_order_value,
               max(order_revenue) AS max_order_value,
               coalesce(stddev_samp(order_revenue), 0) AS std_order_value,
               CAST(sum(order_lines) AS BIGINT) AS total_lines,
               CAST(sum(order_lines) AS BIGINT) / count(*) AS avg_basket_lines,
               sum(order_quantity) AS total_quantity,
               min(order_date) AS first_order_date, max(order_date) AS last_order_date, {windows},
               count(*) FILTER ({previous}) AS orders_prev_90,
               coalesce(round(sum(order_revenue) FILTER ({previous}), 4), 0) AS revenue_prev_90,
               CASE WHEN min(order_date) = max(order_date) THEN 0 ELSE
                 regr_slope(order_revenue, epoch_us(order_date) / 86400000000.0
                            - epoch_us(cohort_date) / 86400000000.0) END AS revenue_trend_slope
        FROM {p}order_facts GROUP BY ALL""",
        [f"{p}order_facts"],
    )
    BLOCKS.add(
        f"{p}gaps",
        f"""
        SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY cohort_date,
               customer_id) AS intervals
        FROM (SELECT cohort_date, customer_id, order_date, invoice_no,
                     lag(order_date) OVER v AS previous_order_date,
                     date_sub('day', lag(order_date) OVER v, order_date) AS interval_days
              FROM {p}order_facts
              WINDOW v AS (PARTITION BY cohort_date, customer_id ORDER BY order_date, invoice_no))
        WHERE interval_days IS NOT NULL
        WINDOW w AS (PARTITION BY cohort_date, customer_id ORDER BY order_date, invoice_no)""",
        [f"{p}order_facts"],
    )
    BLOCKS.add(
        f"{p}interval_facts",
        f"""
        SELECT cohort_date, customer_id, avg(interval_days) AS avg_interval,
               stddev_samp(interval_days) AS std_interval, median(interval_days) AS median_interval,
               max(interval_days) AS max_interval,
               arg_max(interval_days, position) AS days_since_previous_purchase,
               CASE WHEN count(*) < 2 THEN 0 ELSE
                 CAST(sum(interval_days) FILTER (position > intervals // 2) AS DOUBLE)
                   / count(*) FILTER (position > intervals // 2)
                 - CAST(sum(interval_days) FILTER (position <= intervals // 2) AS DOUBLE)
                   / count(*) FILTER (position <= intervals // 2) END AS interval_change
        FROM {p}gaps GROUP BY ALL""",
        [f"{p}gaps"],
    )
    BLOCKS.add(
        f"{p}bought",
        f"""
        SELECT cohort_date, customer_id, count(DISTINCT stock_code) AS n_unique_products,
               count(DISTINCT invoice_month) AS active_months
        FROM {p}seen WHERE NOT is_cancellation GROUP BY ALL""",
        [f"{p}seen"],
    )
    BLOCKS.add(
        f"{p}returned",
        f"""
        SELECT cohort_date, customer_id, count(DISTINCT invoice_no) AS n_cancel_orders,
               round(sum(return_value), 4) AS return_value
        FROM {p}seen WHERE is_cancellation GROUP BY ALL""",
        [f"{p}seen"],
    )
    BLOCKS.add(
        f"{p}homes",
        f"""
        SELECT cohort_date, customer_id, country_grouped FROM (
          SELECT cohort_date, customer_id, country_grouped, row_number() OVER (
                   PARTITION BY cohort_date, customer_id ORDER BY count(*) DESC, country_grouped)
                   AS place
          FROM {p}seen WHERE NOT is_cancellation
          GROUP BY cohort_date, customer_id, country_grouped) WHERE place = 1""",
        [f"{p}seen"],
    )
    BLOCKS.add(
        f"{p}joined",
        f"""
        SELECT core.*, n_unique_products, active_months, coalesce(n_cancel_orders, 0) AS
               n_cancel_orders, coalesce(return_value, 0) AS return_value, country_grouped,
               avg_interval, coalesce(std_interval, 0) AS std_interval, median_interval,
               max_interval, days_since_previous_purchase, coalesce(interval_change, 0) AS
               interval_change, date_sub('day', first_order_date, cohort_date) AS tenure_days,
               date_sub('day', last_order_date, cohort_date) AS recency_days,
               greatest(date_sub('day', first_order_date, cohort_date) / 30.44::DOUBLE, 1)
                 AS tenure_months, gross_revenue - coalesce(return_value, 0) AS net_revenue
        FROM {p}core core LEFT JOIN {p}interval_facts USING (cohort_date, customer_id)
        LEFT JOIN {p}bought USING (cohort_date, customer_id)
        LEFT JOIN {p}returned USING (cohort_date, customer_id)
        LEFT JOIN {p}homes USING (cohort_date, customer_id)""",
        [f"{p}core", f"{p}interval_facts", f"{p}bought", f"{p}returned", f"{p}homes"],
    )
    eps = "1e-6::DOUBLE"
    BLOCKS.add(
        f"{p}features",
        f"""
        SELECT *, n_orders / tenure_months AS purchase_frequency,
          n_orders / greatest(tenure_days, 1) AS overall_order_rate,
          net_revenue / tenure_months AS revenue_per_month,
          return_value / (gross_revenue + {eps}) AS return_value_ratio,
          n_cancel_orders / (n_orders + n_cancel_orders + {eps}) AS cancellation_rate,
          gross_revenue / (greatest(total_quantity, 1) + {eps}) AS avg_unit_price,
          n_unique_products / (greatest(total_lines, 1) + {eps}) AS product_diversity,
          std_order_value / (aov + {eps}) AS order_value_cv,
          std_interval / (avg_interval + {eps}) AS interval_cv,
          CASE WHEN n_orders = 1 THEN 1 ELSE 0 END AS is_single_purchase,
          active_months / (tenure_months + {eps}) AS active_month_ratio,
          n_orders_90 / (n_orders + {eps}) AS recent_order_share,
          revenue_90 / (gross_revenue + {eps}) AS recent_revenue_share,
          n_orders_90 / 90.0::DOUBLE / (n_orders / greatest(tenure_days, 1) + {eps})
            AS order_rate_ratio,
          revenue_90 / 90.0::DOUBLE / (gross_revenue / greatest(tenure_days, 1) + {eps})
            AS revenue_rate_ratio,
          (revenue_90 - revenue_prev_90) / (revenue_prev_90 + 1 + {eps}) AS revenue_growth_90,
          (n_orders_90 - orders_prev_90) / (orders_prev_90 + 1 + {eps}) AS order_growth_90,
          (revenue_90 / (n_orders_90 + {eps}) - revenue_prev_90 / (orders_prev_90 + {eps}))
            / (revenue_prev_90 / (orders_prev_90 + {eps}) + 1 + {eps}) AS aov_change_90,
          recency_days / (coalesce(avg_interval, tenure_days) + {eps})
            AS recency_to_interval_ratio
        FROM {p}joined""",
        [f"{p}joined"],
    )
    horizon = stages.TEMPORAL.performance_window_days
    BLOCKS.add(
        f"{p}future",
        f"""
        SELECT c.cohort_date, customer_id, count(DISTINCT invoice_no) AS future_orders,
               round(sum(line_revenue), 4) AS future_revenue
        FROM slim JOIN {p}cohorts c ON invoice_date > c.cohort_date
          AND invoice_date <= c.cohort_date + INTERVAL {horizon} DAY
        WHERE NOT is_cancellation GROUP BY ALL""",
        ["slim", f"{p}cohorts"],
    )
    BLOCKS.add(
        f"{p}labels",
        f"""
        SELECT cohort_date, customer_id, coalesce(future_orders, 0) AS future_orders,
               coalesce(future_revenue, 0) AS future_revenue,
               CASE WHEN coalesce(future_orders, 0) = 0 THEN 1 ELSE 0 END AS churn
        FROM (SELECT DISTINCT cohort_date, customer_id FROM {p}seen WHERE NOT is_cancellation)
        LEFT JOIN {p}future USING (cohort_date, customer_id)""",
        [f"{p}seen", f"{p}future"],
    )
    BLOCKS.add(
        f"{p}panel",
        f"""SELECT * FROM {p}features JOIN {p}labels USING (cohort_date, customer_id)""",
        [f"{p}features", f"{p}labels"],
    )


add_feature_blocks("", [stages.CUTOFF])
add_feature_blocks("p_", stages.COHORTS.cohort_dates)
add_feature_blocks("t_", stages.COHORTS.test_cohorts)

COUNT_FEATURES = (
    "n_orders total_lines n_orders_30 n_orders_90 n_orders_180 n_orders_365 n_unique_products "
    "n_cancel_orders active_months tenure_days recency_days days_since_previous_purchase "
    "is_single_purchase"
).split()
REAL_FEATURES = (
    "gross_revenue aov median_order_value max_order_value std_order_value avg_basket_lines "
    "total_quantity avg_interval std_interval revenue_30 revenue_90 revenue_180 revenue_365 "
    "revenue_prev_90 return_value revenue_trend_slope interval_change purchase_frequency "
    "overall_order_rate net_revenue revenue_per_month return_value_ratio cancellation_rate "
    "avg_unit_price product_diversity order_value_cv interval_cv active_month_ratio "
    "recent_order_share recent_revenue_share order_rate_ratio revenue_rate_ratio "
    "revenue_growth_90 order_growth_90 aov_change_90 recency_to_interval_ratio"
).split()
NUMERIC_FEATURES = COUNT_FEATURES + REAL_FEATURES


def feature_list() -> str:
    """SQL list of all 50 features."""
    whole = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in COUNT_FEATURES)
    real = ", ".join(f"floor({c} * 10000 + 0.5) / 10000 AS {c}" for c in REAL_FEATURES)
    return f"country_grouped, {whole}, {real}"
