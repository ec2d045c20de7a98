"""Queries on scored customers: metrics, value and risk, survival."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import metrics
from tideline.functions.metrics import CALIBRATION_EDGES, F1_THRESHOLDS
from tideline.operators import calibration, churn, modelling, survival, value
from tideline.operators.features import temporal_split
from tideline.plans import stages
from tideline.plans.blocks import BLOCKS, NUMERIC_FEATURES
from tideline.plans.registry import query, r4, when
from tideline.params import SURVIVAL_FEATURES

BY = ["cohort_date"]
COHORT = when("cohort_date")
LABEL, PROB = "churn", "churn_probability"

BLOCKS.add(
    "scored",
    """SELECT *, 1 / (1 + exp(-((recency_days - 90) / 90.0::DOUBLE))) AS churn_probability,
       greatest(revenue_per_month * 3, 0) AS predicted_90d_value FROM p_panel""",
    ["p_panel"],
)
BLOCKS.add(
    "scored_test",
    f"""SELECT * FROM scored
        WHERE cohort_date = TIMESTAMP '{stages.COHORTS.test_cohorts[0]}'""",
    ["scored"],
)
BLOCKS.add(
    "confusion",
    """
    SELECT cohort_date, count(*) FILTER (churn_probability >= 0.5 AND churn = 1) AS tp,
           count(*) FILTER (churn_probability >= 0.5 AND churn = 0) AS fp,
           count(*) FILTER (churn_probability < 0.5 AND churn = 1) AS fn,
           count(*) FILTER (churn_probability < 0.5 AND churn = 0) AS tn
    FROM scored GROUP BY cohort_date""",
    ["scored"],
)


@query(
    "impute_median",
    BLOCKS.sql(
        "SELECT "
        + r4(
            *[
                f"(SELECT median({c}) FROM p_panel WHERE cohort_date <= TIMESTAMP '2001-02-01') "
                f"AS {c}"
                for c in NUMERIC_FEATURES
            ]
        ),
        "p_panel",
    ),
)
def impute_median(spark, sf_dir):
    train = stages.split(spark, sf_dir, stages.COHORTS.train_cohorts)
    found = modelling.medians(train, NUMERIC_FEATURES)
    return found.groupBy().pivot("feature", NUMERIC_FEATURES).agg(F.first("median"))


@query(
    "impute_mode",
    BLOCKS.sql(
        """
    SELECT customer_id, strftime(cohort_date, '%Y-%m-%d %H:%M:%S') AS cohort_date,
           CASE WHEN country_grouped = 'Other' THEN
             (SELECT country_grouped FROM p_panel WHERE country_grouped <> 'Other'
                AND cohort_date <= TIMESTAMP '2001-02-01'
              GROUP BY country_grouped ORDER BY count(*) DESC, country_grouped LIMIT 1)
             ELSE country_grouped END AS country_grouped
    FROM p_panel""",
        "p_panel",
    ),
)
def impute_mode(spark, sf_dir):
    named = stages.panel(spark, sf_dir).withColumn(
        "country_grouped", F.nullif("country_grouped", F.lit("Other"))
    )
    train = stages.temporal_split(named, stages.COHORTS.train_cohorts)
    filled = modelling.impute_mode(named, train, ["country_grouped"])
    return filled.select("customer_id", "cohort_date", "country_grouped")


SCALED = ["recency_days", "n_orders", "net_revenue", "aov"]


@query(
    "standard_scale",
    BLOCKS.sql(
        f"SELECT customer_id, {COHORT}, "
        + r4(
            *[
                f"({c} - (SELECT avg({c}) FROM p_panel WHERE cohort_date <= TIMESTAMP "
                f"'2001-02-01')) / (SELECT stddev_pop({c}) FROM p_panel WHERE cohort_date <= "
                f"TIMESTAMP '2001-02-01') AS {c}"
                for c in SCALED
            ]
        )
        + " FROM p_panel",
        "p_panel",
    ),
)
def standard_scale(spark, sf_dir):
    train = stages.split(spark, sf_dir, stages.COHORTS.train_cohorts)
    scaled = modelling.standard_scale(stages.panel(spark, sf_dir), train, SCALED)
    return scaled.select("customer_id", "cohort_date", *SCALED)


@query(
    "class_balance",
    BLOCKS.sql(
        """
    SELECT CAST(churn AS BIGINT) AS churn, n_rows,
           floor(CAST(sum(n_rows) OVER () AS DOUBLE) / (count(*) OVER () * n_rows) * 10000 + 0.5)
             / 10000 AS class_weight
    FROM (SELECT churn, count(*) AS n_rows FROM p_panel GROUP BY churn)""",
        "p_panel",
    ),
)
def class_balance(spark, sf_dir):
    return modelling.class_balance(stages.panel(spark, sf_dir), "churn")


BLOCKS.add(
    "distinct_scores",
    f"""SELECT *, row_number() OVER (ORDER BY s) AS i, sum(n) OVER (ORDER BY s) AS n_upto,
      sum(y) OVER (ORDER BY s) AS y_upto
    FROM (SELECT churn_probability AS s, count(*) AS n, sum(churn) AS y FROM scored
          WHERE cohort_date = TIMESTAMP '{stages.COHORTS.validation_cohorts[0]}' GROUP BY churn_probability)""",
    ["scored"],
)
BLOCKS.add(
    "isotonic",
    """SELECT b AS i, max(least_after) AS fit FROM (
      SELECT x.i AS a, z.i AS b, min((z.y_upto - x.y_upto + x.y) / (z.n_upto - x.n_upto + x.n)::DOUBLE)
        OVER (PARTITION BY x.i ORDER BY z.i DESC) AS least_after
      FROM distinct_scores AS x JOIN distinct_scores AS z ON x.i <= z.i) GROUP BY b""",
    ["distinct_scores"],
)


@query(
    "calibrate_isotonic",
    BLOCKS.sql(
        f"""SELECT customer_id, {r4("raw", "coalesce(lo.fit + CASE WHEN hi.s > lo.s "
            "THEN (raw - lo.s) / (hi.s - lo.s) * (hi.fit - lo.fit) ELSE 0 END, lo.fit, hi.fit) AS calibrated")}
        FROM (SELECT customer_id, churn_probability AS raw, (SELECT max(s) FROM distinct_scores WHERE s <= churn_probability) AS below,
                (SELECT min(s) FROM distinct_scores WHERE s >= churn_probability) AS above FROM scored_test) AS t
        LEFT JOIN (SELECT s, fit FROM distinct_scores JOIN isotonic USING (i)) AS lo ON lo.s = t.below
        LEFT JOIN (SELECT s, fit FROM distinct_scores JOIN isotonic USING (i)) AS hi ON hi.s = t.above""",
        "scored_test",
        "isotonic",
    ),
)
def calibrate_isotonic(spark, sf_dir):
    """Scores by the plain formula, calibrated on the validation cohort: the max-min formula in SQL."""
    known = stages.scored(spark, sf_dir)
    pools = stages.materialise(
        calibration.isotonic_pools(temporal_split(known, stages.COHORTS.validation_cohorts), PROB, LABEL)
    )
    test = stages.scored_test(spark, sf_dir).select("customer_id", F.col(PROB).alias("raw"))
    return calibration.calibrated(test, "raw", pools, "calibrated")


@query(
    "calibration_gate",
    BLOCKS.sql(
        f"""
    SELECT {r4("brier_raw", "brier_calibrated")}, brier_calibrated < brier_raw
             AS calibration_applied
    FROM (SELECT avg(pow(churn_probability - churn, 2)) AS brier_raw,
                 avg(pow(0.5 + churn_probability / 4 - churn, 2)) AS brier_calibrated
          FROM scored)""",
        "scored",
    ),
)
def calibration_gate(spark, sf_dir):
    shrunk = stages.scored(spark, sf_dir).withColumn("calibrated", 0.5 + F.col(PROB) / 4)
    return churn.calibration_gate(shrunk, LABEL, PROB, "calibrated")


@query(
    "roc_auc",
    BLOCKS.sql(
        f"""
    SELECT {COHORT}, {r4("(ranks - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS roc_auc")}
    FROM (SELECT cohort_date, sum(place) FILTER (churn = 1) AS ranks,
                 count(*) FILTER (churn = 1) AS n1, count(*) FILTER (churn = 0) AS n0
          FROM (SELECT cohort_date, churn,
                       rank() OVER (PARTITION BY cohort_date ORDER BY churn_probability)
                       + (count(*) OVER (PARTITION BY cohort_date, churn_probability) - 1)
                         / 2.0::DOUBLE AS place FROM scored)
          GROUP BY cohort_date)""",
        "scored",
    ),
)
def roc_auc(spark, sf_dir):
    curve = metrics.rank_curve(stages.scored(spark, sf_dir), LABEL, PROB, BY)
    return curve.select("cohort_date", "roc_auc")


@query(
    "average_precision",
    BLOCKS.sql(
        f"""
    SELECT {COHORT}, {r4("sum(pos * tp / CAST(tp + fp AS DOUBLE)) / sum(pos) AS pr_auc")}
    FROM (SELECT cohort_date, pos, CAST(sum(pos) OVER w AS BIGINT) AS tp,
                 CAST(sum(neg) OVER w AS BIGINT) AS fp
          FROM (SELECT cohort_date, churn_probability, count(*) FILTER (churn = 1) AS pos,
                       count(*) FILTER (churn = 0) AS neg FROM scored GROUP BY ALL)
          WINDOW w AS (PARTITION BY cohort_date ORDER BY churn_probability DESC))
    GROUP BY cohort_date""",
        "scored",
    ),
)
def average_precision(spark, sf_dir):
    curve = metrics.rank_curve(stages.scored(spark, sf_dir), LABEL, PROB, BY)
    return curve.select("cohort_date", "pr_auc")


@query(
    "precision_recall_f1",
    BLOCKS.sql(
        f"""SELECT {COHORT}, {r4("tp / (tp + fp) AS precision", "tp / (tp + fn) AS recall",
            "2 * tp / (2 * tp + fp + fn) AS f1")} FROM confusion""",
        "confusion",
    ),
)
def precision_recall_f1(spark, sf_dir):
    counts = metrics.confusion_matrix(stages.scored(spark, sf_dir), LABEL, PROB, 0.5, BY)
    return metrics.precision_recall_f1(counts).select("cohort_date", "precision", "recall", "f1")


@query(
    "confusion_matrix",
    BLOCKS.sql(
        f"SELECT {COHORT}, tp AS true_positives, fp AS false_positives, fn AS false_negatives, "
        "tn AS true_negatives FROM confusion",
        "confusion",
    ),
)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(stages.scored(spark, sf_dir), LABEL, PROB, 0.5, BY)


CLIPPED = "least(greatest(churn_probability, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)"


@query(
    "brier",
    BLOCKS.sql(
        f"SELECT {COHORT}, {r4('brier')} FROM (SELECT cohort_date, "
        "avg(pow(churn_probability - churn, 2)) AS brier FROM scored GROUP BY cohort_date)",
        "scored",
    ),
)
def brier(spark, sf_dir):
    return (
        stages.scored(spark, sf_dir)
        .groupBy("cohort_date")
        .agg(metrics.brier(F.col(LABEL), F.col(PROB)).alias("brier"))
    )


@query(
    "log_loss",
    BLOCKS.sql(
        f"SELECT {COHORT}, {r4('log_loss')} FROM (SELECT cohort_date, avg(CASE WHEN churn = 1 "
        f"THEN -ln({CLIPPED}) ELSE -ln(1 - {CLIPPED}) END) AS log_loss "
        "FROM scored GROUP BY cohort_date)",
        "scored",
    ),
)
def log_loss(spark, sf_dir):
    return (
        stages.scored(spark, sf_dir)
        .groupBy("cohort_date")
        .agg(metrics.log_loss(F.col(LABEL), F.col(PROB)).alias("log_loss"))
    )


BIN = " + ".join(f"(churn_probability >= {e!r}::DOUBLE)::INT" for e in CALIBRATION_EDGES)


@query(
    "calibration_error",
    BLOCKS.sql(
        f"""
    SELECT {COHORT}, {r4("expected_calibration_error")}
    FROM (SELECT cohort_date, sum(n * gap) / sum(n) AS expected_calibration_error
          FROM (SELECT cohort_date, {BIN} AS bin, count(*) AS n,
                       abs(avg(churn) - avg(churn_probability)) AS gap
                FROM scored GROUP BY ALL) GROUP BY cohort_date)""",
        "scored",
    ),
)
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(stages.scored(spark, sf_dir), LABEL, PROB, BY)


@query(
    "best_f1_threshold",
    BLOCKS.sql(
        f"""
    SELECT {r4("t AS threshold", "f1")}
    FROM (SELECT t, 2 * count(*) FILTER (churn_probability >= t AND churn = 1)
                 / CAST(count(*) FILTER (churn_probability >= t)
                        + count(*) FILTER (churn = 1) AS DOUBLE) AS f1
          FROM scored, (VALUES {", ".join(f"({t!r}::DOUBLE)" for t in F1_THRESHOLDS)}) AS v(t)
          GROUP BY t) ORDER BY f1 DESC, t LIMIT 1""",
        "scored",
    ),
)
def best_f1_threshold(spark, sf_dir):
    return metrics.best_f1_threshold(stages.scored(spark, sf_dir), LABEL, PROB)


@query(
    "top_fraction_capture",
    BLOCKS.sql(
        f"""
    SELECT {r4("fraction", "captured / total AS capture_rate", "captured / k AS precision",
               "captured / k / (total / n) AS lift")},
           CAST(k AS BIGINT) AS n_selected, CAST(captured AS BIGINT) AS n_captured
    FROM (SELECT fraction, greatest(1, floor(max(n) * fraction)) AS k, max(n) AS n,
                 CAST(sum(churn) AS DOUBLE) AS total,
                 CAST(sum(churn) FILTER (place <= greatest(1, floor(n * fraction))) AS DOUBLE)
                   AS captured
          FROM (SELECT churn, CAST(count(*) OVER () AS DOUBLE) AS n, row_number() OVER (
                         ORDER BY churn_probability DESC, customer_id) AS place
                FROM scored_test),
               (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) AS f(fraction) GROUP BY fraction)""",
        "scored_test",
    ),
)
def top_fraction_capture(spark, sf_dir):
    return metrics.top_fraction_capture(
        stages.scored_test(spark, sf_dir), LABEL, PROB, "customer_id", [0.1, 0.2]
    )


@query(
    "regression_metrics",
    BLOCKS.sql(
        f"""
    SELECT {COHORT}, n_rows, {r4(
        "mae", "sqrt(mse) AS rmse", "1 - mse / variance AS r2", "mean_actual", "mean_predicted",
        "mean_predicted / (mean_actual + 1e-6::DOUBLE) AS prediction_to_actual_ratio",
        "spearman", "top / (total + 1e-6::DOUBLE) AS top_decile_value_capture")}
    FROM (SELECT cohort_date, count(*) AS n_rows, avg(abs(y - p)) AS mae, avg(pow(y - p, 2)) AS mse,
                 var_pop(y) AS variance, avg(y) AS mean_actual, avg(p) AS mean_predicted,
                 corr(ry, rp) AS spearman, sum(y) AS total,
                 sum(y) FILTER (place <= greatest(1, floor(n * 0.1::DOUBLE))) AS top
          FROM (SELECT cohort_date, future_revenue AS y, predicted_90d_value AS p,
                  rank() OVER (PARTITION BY cohort_date ORDER BY future_revenue)
                    + (count(*) OVER (PARTITION BY cohort_date, future_revenue) - 1) / 2.0::DOUBLE
                    AS ry,
                  rank() OVER (PARTITION BY cohort_date ORDER BY predicted_90d_value)
                    + (count(*) OVER (PARTITION BY cohort_date, predicted_90d_value) - 1)
                    / 2.0::DOUBLE AS rp,
                  row_number() OVER (PARTITION BY cohort_date
                    ORDER BY predicted_90d_value DESC, customer_id) AS place,
                  CAST(count(*) OVER (PARTITION BY cohort_date) AS DOUBLE) AS n
                FROM scored)
          GROUP BY cohort_date)""",
        "scored",
    ),
)
def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(
        stages.scored(spark, sf_dir), "future_revenue", "predicted_90d_value", "customer_id", BY
    )


BLOCKS.add(
    "kept_share",
    """SELECT *, least(greatest(1.0::DOUBLE - churn_probability, 0.1::DOUBLE), 0.999::DOUBLE)
       AS retention_probability FROM scored_test""",
    ["scored_test"],
)
BLOCKS.add(
    "value_risk",
    """
    SELECT *, churn_probability * expected_future_clv AS revenue_at_risk
    FROM (SELECT customer_id, cohort_date, net_revenue AS historical_value,
                 n_orders AS historical_orders, churn_probability, retention_probability,
                 predicted_90d_value,
                 predicted_90d_value / retention_probability AS value_per_active_period,
                 predicted_90d_value / retention_probability
                   * ((1 - pow(retention_probability, 365.0::DOUBLE / 90))
                      / (1 - retention_probability)) AS expected_future_clv,
                 future_revenue AS actual_future_revenue, recency_days, churn
          FROM kept_share)""",
    ["kept_share"],
)
VALUE_COLUMNS = [
    "historical_value", "churn_probability", "retention_probability", "predicted_90d_value",
    "value_per_active_period", "expected_future_clv", "revenue_at_risk", "actual_future_revenue",
]


@query(
    "value_and_risk",
    BLOCKS.sql(
        f"SELECT customer_id, {COHORT}, historical_orders, {r4(*VALUE_COLUMNS)} FROM value_risk",
        "value_risk",
    ),
)
def value_and_risk(spark, sf_dir):
    return stages.value_risk(spark, sf_dir)


@query(
    "risk_summary",
    BLOCKS.sql(
        f"""
    SELECT count(*) AS n_customers, {r4(
        "365.0 AS horizon_days", "0.0 AS discount_rate_annual",
        "0.1 AS min_retention_probability", "avg(churn_probability) AS mean_churn_probability",
        "round(sum(historical_value), 2) AS total_historical_value",
        "round(sum(predicted_90d_value), 2) AS total_predicted_90d_value",
        "round(sum(expected_future_clv), 2) AS total_expected_future_clv",
        "round(sum(revenue_at_risk), 2) AS total_revenue_at_risk",
        "sum(revenue_at_risk) FILTER (place <= greatest(1, floor(n * 0.1::DOUBLE))) "
        "/ sum(revenue_at_risk) AS revenue_at_risk_top_decile_share")}
    FROM (SELECT *, row_number() OVER (ORDER BY revenue_at_risk DESC, customer_id) AS place,
                 count(*) OVER () AS n FROM value_risk)""",
        "value_risk",
    ),
)
def risk_summary(spark, sf_dir):
    return value.risk_summary(stages.value_risk(spark, sf_dir))


BLOCKS.add(
    "quintiles",
    """
    SELECT customer_id, greatest(1, (5 * (r - 1) + n - 2) // (n - 1)) - 1 AS rq,
           greatest(1, (5 * (f - 1) + n - 2) // (n - 1)) - 1 AS fq,
           greatest(1, (5 * (m - 1) + n - 2) // (n - 1)) - 1 AS mq
    FROM (SELECT customer_id, count(*) OVER () AS n,
                 row_number() OVER (ORDER BY recency_days, customer_id) AS r,
                 row_number() OVER (ORDER BY n_orders, customer_id) AS f,
                 row_number() OVER (ORDER BY net_revenue, customer_id) AS m FROM features)""",
    ["features"],
)
BLOCKS.add(
    "rule_segments",
    """
    SELECT customer_id, least(n_orders // 5, 4) AS cluster,
           CASE WHEN return_value_ratio > 0.5 THEN 'High-return customers'
                WHEN tenure_days < 180 AND fq + 1 <= 2 THEN 'New customers'
                WHEN 6 - rq >= 4 AND fq + 1 >= 4 AND mq + 1 >= 4 THEN 'Champions'
                WHEN mq + 1 >= 4 AND 6 - rq <= 2 THEN 'High-value at risk'
                WHEN 6 - rq <= 1 THEN 'Lost customers'
                WHEN fq + 1 <= 2 AND mq + 1 <= 2 THEN 'Occasional buyers'
                WHEN 6 - rq >= 3 AND fq + 1 >= 3 THEN 'Loyal customers'
                ELSE 'Occasional buyers' END AS rule_segment
    FROM features JOIN quintiles USING (customer_id)""",
    ["features", "quintiles"],
)
BLOCKS.add(
    "lifetimes",
    """
    SELECT customer_id, rule_segment AS segment_name, churn AS event, n_orders,
           CASE WHEN churn = 1 THEN greatest(tenure_days - recency_days, 1)
                ELSE greatest(tenure_days, 1) END AS duration
    FROM features JOIN labels USING (customer_id) LEFT JOIN rule_segments USING (customer_id)""",
    ["features", "labels", "rule_segments"],
)


@query(
    "survival_input",
    BLOCKS.sql(
        "SELECT customer_id, segment_name, CAST(event AS BIGINT) AS event, "
        "CAST(duration AS BIGINT) AS duration FROM lifetimes",
        "lifetimes",
    ),
)
def survival_input(spark, sf_dir):
    return stages.survival_data(spark, sf_dir).select(
        "customer_id", "segment_name", "event", "duration"
    )


BLOCKS.add(
    "curve_steps",
    """
    SELECT segment, duration, d, sum(n) OVER (PARTITION BY segment ORDER BY duration DESC) AS at_risk
    FROM (SELECT segment, duration, sum(event) AS d, count(*) AS n
          FROM (SELECT 'Overall' AS segment, duration, event FROM lifetimes UNION ALL
                SELECT segment_name, duration, event FROM lifetimes WHERE segment_name IS NOT NULL)
          GROUP BY ALL)""",
    ["lifetimes"],
)
BLOCKS.add(
    "curves",
    """
    SELECT segment, CAST(duration AS DOUBLE) AS time_days,
           CASE WHEN max(CASE WHEN d = at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0
             ELSE exp(sum(ln(CASE WHEN d < at_risk THEN 1 - CAST(d AS DOUBLE) / at_risk
                             ELSE 1 END)) OVER w) END AS survival
    FROM curve_steps WINDOW w AS (PARTITION BY segment ORDER BY duration)
    UNION ALL SELECT DISTINCT segment, 0, 1 FROM curve_steps""",
    ["curve_steps"],
)


@query(
    "kaplan_meier",
    BLOCKS.sql(f"SELECT segment, {r4('time_days', 'survival')} FROM curves", "curves"),
)
def kaplan_meier(spark, sf_dir):
    return survival.kaplan_meier(stages.survival_data(spark, sf_dir))


@query(
    "median_survival",
    BLOCKS.sql(
        "SELECT segment, coalesce(min(time_days) FILTER (survival <= 0.5), 'inf'::DOUBLE) "
        "AS median_survival_days FROM curves GROUP BY segment",
        "curves",
    ),
)
def median_survival(spark, sf_dir):
    return survival.median_survival(survival.kaplan_meier(stages.survival_data(spark, sf_dir)))


@query(
    "concordance",
    BLOCKS.sql(
        f"""
    SELECT concordant, discordant, tied_risk, {r4(
        "(concordant + tied_risk / 2.0::DOUBLE) / (concordant + discordant + tied_risk) "
        "AS concordance_index")}
    FROM (SELECT count(*) FILTER (a.n_orders < b.n_orders) AS concordant,
                 count(*) FILTER (a.n_orders > b.n_orders) AS discordant,
                 count(*) FILTER (a.n_orders = b.n_orders) AS tied_risk
          FROM lifetimes a JOIN lifetimes b ON a.event = 1 AND a.customer_id <> b.customer_id
            AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0)))""",
        "lifetimes",
    ),
)
def concordance(spark, sf_dir):
    data = stages.survival_data(spark, sf_dir).withColumn("risk", -F.col("n_orders"))
    found = survival.concordance(data, "duration", "event", "risk")
    return found.withColumns(
        {c: F.col(c).cast("long") for c in ("concordant", "discordant", "tied_risk")}
    )


@query("cox_ph")
def cox_ph(spark, sf_dir):
    fit = survival.cox_ph(stages.survival_data(spark, sf_dir))
    return spark.createDataFrame(fit.summary())


@query("survival_report")
def survival_report(spark, sf_dir):
    data = stages.materialise(
        stages.survival_data(spark, sf_dir).select(
            "customer_id", "segment_name", "event", "duration", *SURVIVAL_FEATURES
        )
    )
    fit = survival.cox_ph(data)
    filled = modelling.impute_median(data, data, SURVIVAL_FEATURES)
    scored = filled.withColumn("risk", fit.risk())
    index = survival.concordance(scored, "duration", "event", "risk").head()["concordance_index"]
    return survival.survival_report(data, survival.kaplan_meier(data), fit, index)
