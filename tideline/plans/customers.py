"""Queries on customers: feature store, labels, panel and baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import baseline
from tideline.operators import features as ops
from tideline.plans import stages
from tideline.plans.blocks import BLOCKS, COUNT_FEATURES, REAL_FEATURES, feature_list
from tideline.plans.registry import query, r4, when

LAST_DAY = f"TIMESTAMP '{stages.CUTOFF}'"
HORIZON = stages.TEMPORAL.performance_window_days


def _whole(*columns: str) -> str:
    return ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in columns)


@query(
    "observation_window",
    BLOCKS.sql(
        f"SELECT invoice_no, stock_code, {when('invoice_date')} FROM slim "
        f"WHERE slim.invoice_date <= {LAST_DAY}",
        "slim",
    ),
)
def observation_window(spark, sf_dir):
    seen = ops.observation_window(stages.lean_curated(spark, sf_dir), stages.CUTOFF)
    return seen.select("invoice_no", "stock_code", "invoice_date")


@query(
    "performance_window",
    BLOCKS.sql(
        f"SELECT invoice_no, stock_code, {when('invoice_date')} FROM slim "
        f"WHERE slim.invoice_date > {LAST_DAY} "
        f"AND slim.invoice_date <= {LAST_DAY} + INTERVAL {HORIZON} DAY",
        "slim",
    ),
)
def performance_window(spark, sf_dir):
    ahead = ops.performance_window(stages.lean_curated(spark, sf_dir), stages.CUTOFF, HORIZON)
    return ahead.select("invoice_no", "stock_code", "invoice_date")


@query(
    "eligible_customers",
    BLOCKS.sql("SELECT DISTINCT customer_id FROM seen WHERE NOT is_cancellation", "seen"),
)
def eligible_customers(spark, sf_dir):
    return ops.eligible_customers(stages.lean_curated(spark, sf_dir), stages.CUTOFF)


@query(
    "split_purchase_cancel",
    BLOCKS.sql(
        "SELECT customer_id, count(*) FILTER (NOT is_cancellation) AS purchase_lines, "
        "count(*) FILTER (is_cancellation) AS cancelled_lines, "
        + r4(
            "round(sum(line_revenue) FILTER (NOT is_cancellation), 4) AS purchase_revenue",
            "round(sum(return_value) FILTER (is_cancellation), 4) AS returned_value",
        )
        + " FROM seen GROUP BY customer_id",
        "seen",
    ),
)
def split_purchase_cancel(spark, sf_dir):
    seen = ops.observation_window(stages.lean_curated(spark, sf_dir), stages.CUTOFF)
    return ops.split_purchase_cancel(seen)


@query(
    "order_rollup",
    BLOCKS.sql(
        f"SELECT {when('cohort_date')}, customer_id, invoice_no, {when('order_date')}, "
        f"{_whole('order_lines')}, {r4('order_revenue', 'order_quantity')} FROM order_facts",
        "order_facts",
    ),
)
def order_rollup(spark, sf_dir):
    return stages.orders(spark, sf_dir)


def _core(*, whole=(), real=(), dates=(), block="core") -> str:
    parts = ["customer_id"]
    parts += [_whole(*whole)] if whole else []
    parts += [r4(*real)] if real else []
    parts += [when(d) for d in dates]
    return BLOCKS.sql(f"SELECT {', '.join(parts)} FROM {block}", block)


@query(
    "rfm_core",
    _core(
        whole=["n_orders", "total_lines"],
        real=["gross_revenue", "aov", "median_order_value", "max_order_value", "std_order_value",
              "avg_basket_lines", "total_quantity"],
        dates=["first_order_date", "last_order_date"],
    ),
)
def rfm_core(spark, sf_dir):
    orders = stages.materialise(stages.orders(spark, sf_dir))
    return (
        ops.rfm_core(orders)
        .join(ops.median_order_value(orders), list(ops.KEYS))
        .drop("cohort_date")
    )


@query(
    "interval_lag",
    BLOCKS.sql(
        """SELECT customer_id, date_sub('day', order_date, cohort_date) AS age_days,
           CAST(sum(interval_days) AS BIGINT) AS interval_days,
           CAST(count(*) AS BIGINT) AS intervals
           FROM gaps GROUP BY ALL""",
        "gaps",
    ),
)
def interval_lag(spark, sf_dir):
    lagged = ops.interval_lag(stages.orders(spark, sf_dir))
    counted = lagged.select(
        "customer_id",
        ops.elapsed_days(F.col("first_at"), F.col("cohort_date")).alias("age_days"),
        F.coalesce("interval_days", F.lit(0)).cast("long").alias("interval_days"),
        (F.col("same_day_intervals") + F.col("interval_days").isNotNull().cast("int")).alias(
            "intervals"
        ),
    )
    return counted.filter(F.col("intervals") > 0)


@query(
    "interval_stats",
    _core(
        whole=["max_interval"],
        real=["avg_interval", "coalesce(std_interval, 0) AS std_interval", "median_interval"],
        block="interval_facts",
    ),
)
def interval_stats(spark, sf_dir):
    stats = ops.interval_stats(stages.orders(spark, sf_dir))
    return stats.filter(F.col("avg_interval").isNotNull()).select(
        "customer_id", "max_interval", "avg_interval", "std_interval", "median_interval"
    )


@query(
    "last_interval",
    _core(whole=["days_since_previous_purchase"], block="interval_facts"),
)
def last_interval(spark, sf_dir):
    stats = ops.interval_stats(stages.orders(spark, sf_dir))
    return stats.select("customer_id", "days_since_previous_purchase").dropna()


@query(
    "interval_change",
    BLOCKS.sql("SELECT customer_id, " + r4("interval_change") + " FROM joined", "joined"),
)
def interval_change(spark, sf_dir):
    stats = ops.interval_stats(stages.orders(spark, sf_dir))
    return stats.select("customer_id", "interval_change")


@query(
    "rolling_windows",
    _core(
        whole=[f"n_orders_{w}" for w in stages.TEMPORAL.recent_windows],
        real=[f"revenue_{w}" for w in stages.TEMPORAL.recent_windows],
    ),
)
def rolling_windows(spark, sf_dir):
    return ops.rolling_windows(stages.orders(spark, sf_dir)).drop("cohort_date")


@query("previous_window", _core(whole=["orders_prev_90"], real=["revenue_prev_90"]))
def previous_window(spark, sf_dir):
    return ops.previous_window(stages.orders(spark, sf_dir)).drop("cohort_date")


@query("order_value_trend", _core(real=["revenue_trend_slope"]))
def order_value_trend(spark, sf_dir):
    return ops.order_value_trend(stages.orders(spark, sf_dir)).drop("cohort_date")


@query(
    "product_signals",
    BLOCKS.sql("SELECT customer_id, n_unique_products FROM bought", "bought"),
)
def product_signals(spark, sf_dir):
    lines = stages.lean_curated(spark, sf_dir)
    return ops.product_signals(lines, stages.cutoffs()).drop("cohort_date")


@query(
    "return_signals",
    BLOCKS.sql(
        f"SELECT customer_id, n_cancel_orders, {r4('return_value')} FROM returned", "returned"
    ),
)
def return_signals(spark, sf_dir):
    rollup = stages.rollup(spark, sf_dir)
    return ops.return_signals(rollup, stages.cutoffs()).drop("cohort_date")


@query(
    "active_months", BLOCKS.sql("SELECT customer_id, active_months FROM bought", "bought")
)
def active_months(spark, sf_dir):
    rollup = stages.rollup(spark, sf_dir)
    return ops.active_months(rollup, stages.cutoffs()).drop("cohort_date")


@query(
    "modal_country", BLOCKS.sql("SELECT customer_id, country_grouped FROM homes", "homes")
)
def modal_country(spark, sf_dir):
    rollup = stages.rollup(spark, sf_dir)
    return ops.modal_country(rollup, stages.cutoffs()).drop("cohort_date")


@query("feature_assembly", BLOCKS.sql(f"SELECT customer_id, {feature_list()} FROM features", "features"))
def feature_assembly(spark, sf_dir):
    return ops.customer_features(stages.lean_curated(spark, sf_dir), stages.TEMPORAL)


FILLED = (
    "n_cancel_orders", "n_orders_30", "n_orders_90", "n_orders_180", "n_orders_365",
)
FILLED_REAL = (
    "std_order_value", "std_interval", "return_value", "revenue_30", "revenue_90", "revenue_180",
    "revenue_365", "revenue_prev_90", "revenue_trend_slope",
)


@query(
    "fill_defaults",
    BLOCKS.sql(
        f"SELECT customer_id, country_grouped, {_whole(*FILLED)}, {r4(*FILLED_REAL)} FROM joined",
        "joined",
    ),
)
def fill_defaults(spark, sf_dir):
    return stages.features(spark, sf_dir).select(
        "customer_id", "country_grouped", *FILLED, *FILLED_REAL
    )


RATIOS = [c for c in REAL_FEATURES if c.endswith(("ratio", "rate", "share", "cv", "_90", "frequency"))
          and not c.startswith(("revenue_90", "revenue_prev"))]


@query(
    "feature_formulas",
    BLOCKS.sql(
        f"SELECT customer_id, {_whole('tenure_days', 'recency_days', 'is_single_purchase')}, "
        f"{r4(*RATIOS)} FROM features",
        "features",
    ),
)
def feature_formulas(spark, sf_dir):
    return stages.features(spark, sf_dir).select(
        "customer_id", "tenure_days", "recency_days", "is_single_purchase", *RATIOS
    )


@query(
    "inf_to_null",
    BLOCKS.sql(
        "SELECT customer_id, " + r4("CASE WHEN recency_days > 0 THEN n_orders / recency_days END "
        "AS orders_per_recency_day") + " FROM features",
        "features",
    ),
)
def inf_to_null(spark, sf_dir):
    days = F.col("recency_days").cast("double")
    infinite = F.lit(float("inf"))
    ratio = F.when(days == 0, infinite).otherwise(F.col("n_orders") / F.nullif(days, F.lit(0.0)))
    with_ratio = stages.features(spark, sf_dir).select(
        "customer_id", ratio.alias("orders_per_recency_day")
    )
    return ops.inf_to_null(with_ratio)


@query(
    "drop_intermediates",
    BLOCKS.sql(
        "SELECT CAST(count(*) AS BIGINT) AS customers, "
        f"CAST({1 + 1 + len(COUNT_FEATURES) + len(REAL_FEATURES)} AS BIGINT) AS columns FROM features",
        "features",
    ),
)
def drop_intermediates(spark, sf_dir):
    kept = ops.drop_intermediates(stages.features(spark, sf_dir))
    return kept.agg(
        F.count(F.lit(1)).alias("customers"), F.lit(len(kept.columns)).alias("columns")
    )


LABELS = (
    f"customer_id, {_whole('future_orders', 'churn')}, {r4('future_revenue')}, "
    f"strftime(cohort_date, '%Y-%m-%d %H:%M:%S') AS cutoff_date, "
    f"strftime(cohort_date + INTERVAL {HORIZON} DAY, '%Y-%m-%d %H:%M:%S') AS performance_end_date"
)


@query("churn_labels", BLOCKS.sql(f"SELECT {LABELS} FROM labels", "labels"))
def churn_labels(spark, sf_dir):
    return ops.customer_labels(stages.lean_curated(spark, sf_dir), stages.TEMPORAL)


BLOCKS.add(
    "baseline",
    """
    SELECT customer_id, recency_days, n_orders, gross_revenue, net_revenue, return_value,
           revenue_per_month, country_grouped, recency_days > 90 AS baseline_target,
           revenue_per_month * 12 AS historical_value_proxy
    FROM features""",
    ["features"],
)


@query(
    "baseline_scores",
    BLOCKS.sql(
        f"SELECT customer_id, {_whole('recency_days', 'n_orders')}, country_grouped, "
        "baseline_target, "
        + r4("gross_revenue", "net_revenue", "return_value", "revenue_per_month",
             "historical_value_proxy")
        + " FROM baseline",
        "baseline",
    ),
)
def baseline_scores(spark, sf_dir):
    return baseline.baseline_scores(stages.features(spark, sf_dir))


@query(
    "baseline_report",
    BLOCKS.sql(
        f"""
    SELECT 'baseline_recency_rule' AS strategy, 'recency_days > 90' AS rule,
           '12 x observed monthly net revenue (annualised run-rate)' AS value_proxy_definition,
           '{stages.CUTOFF}' AS cutoff_date,
           strftime({LAST_DAY} + INTERVAL {HORIZON} DAY, '%Y-%m-%d') AS performance_end_date,
           n_customers, n_targeted, n_actual_churners, true_positives, false_positives,
           false_negatives, true_negatives,
           {r4("historical_revenue_targeted", "future_value_proxy_targeted",
               "future_value_proxy_all_churners", "potential_revenue_protected_proxy",
               "observed_future_revenue_targeted",
               "round(n_targeted / n_customers, 4) AS targeted_share",
               "round(n_actual_churners / n_customers, 4) AS overall_churn_rate",
               "round(true_positives / n_targeted, 4) AS precision",
               "round(true_positives / n_actual_churners, 4) AS recall",
               "round(2 * true_positives / (n_targeted + n_actual_churners), 4) AS f1")}
    FROM (SELECT count(*) AS n_customers, count(*) FILTER (baseline_target) AS n_targeted,
                 count(*) FILTER (churn = 1) AS n_actual_churners,
                 count(*) FILTER (baseline_target AND churn = 1) AS true_positives,
                 count(*) FILTER (baseline_target AND churn = 0) AS false_positives,
                 count(*) FILTER (NOT baseline_target AND churn = 1) AS false_negatives,
                 count(*) FILTER (NOT baseline_target AND churn = 0) AS true_negatives,
                 round(sum(gross_revenue) FILTER (baseline_target), 2)
                   AS historical_revenue_targeted,
                 round(sum(historical_value_proxy) FILTER (baseline_target), 2)
                   AS future_value_proxy_targeted,
                 round(sum(historical_value_proxy) FILTER (churn = 1), 2)
                   AS future_value_proxy_all_churners,
                 round(sum(historical_value_proxy) FILTER (baseline_target AND churn = 1), 2)
                   AS potential_revenue_protected_proxy,
                 round(sum(future_revenue) FILTER (baseline_target), 2)
                   AS observed_future_revenue_targeted
          FROM baseline JOIN labels USING (customer_id))""",
        "baseline",
        "labels",
    ),
)
def baseline_report(spark, sf_dir):
    scores = baseline.baseline_scores(stages.features(spark, sf_dir))
    return baseline.baseline_report(scores, stages.labels(spark, sf_dir))


@query(
    "cohort_panel",
    BLOCKS.sql(
        f"SELECT {when('cohort_date')}, customer_id, {feature_list()}, "
        f"{_whole('churn', 'future_orders')}, {r4('future_revenue')} FROM p_panel",
        "p_panel",
    ),
)
def cohort_panel(spark, sf_dir):
    return ops.cohort_panel(
        stages.lean_curated(spark, sf_dir), stages.COHORTS.cohort_dates, stages.TEMPORAL
    )


@query(
    "temporal_split",
    BLOCKS.sql(
        """
    SELECT CASE WHEN cohort_date = TIMESTAMP '2001-03-01' THEN 'validation'
                WHEN cohort_date = TIMESTAMP '2001-04-01' THEN 'test' ELSE 'train' END AS split,
           count(*) AS customers, CAST(sum(churn) AS BIGINT) AS churners,
           CAST(sum(future_orders) AS BIGINT) AS future_orders
    FROM p_panel GROUP BY ALL""",
        "p_panel",
    ),
)
def temporal_split(spark, sf_dir):
    panel, cohorts = stages.panel(spark, sf_dir), stages.COHORTS
    parts = {
        "train": cohorts.train_cohorts,
        "validation": cohorts.validation_cohorts,
        "test": cohorts.test_cohorts,
    }
    counted = [
        ops.temporal_split(panel, dates).agg(
            F.lit(name).alias("split"),
            F.count(F.lit(1)).alias("customers"),
            F.sum("churn").alias("churners"),
            F.sum("future_orders").alias("future_orders"),
        )
        for name, dates in parts.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])

