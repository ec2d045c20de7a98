"""Queries on segments, priorities, explanations, recommendations and report pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import (
    explain,
    prioritisation,
    recommendations,
    segmentation,
    views,
)
from tideline.params import (
    ACTION_BY_FACTOR,
    ACTION_BY_SEGMENT,
    ACTION_FALLBACK,
    CAPTURE_FRACTIONS,
    CLUSTER_FEATURES,
    LOG_FEATURES,
    STRATEGY_BY_SEGMENT,
    STRATEGY_FALLBACK,
    STRATEGY_SCORES,
)
from tideline.plans import stages
from tideline.plans.blocks import BLOCKS, quoted
from tideline.plans.registry import query, r4, when
from tideline.plans.scores import VALUE_COLUMNS

COHORT = when("cohort_date")
BUDGETS = stages.PRIORITY.budgets


def _cases(entries: dict[str, str], column: str, fallback: str = "NULL") -> str:
    parts = " ".join(f"WHEN {quoted([k])} THEN {quoted([v])}" for k, v in entries.items())
    return f"CASE {column} {parts} ELSE {fallback} END"


BLOCKS.add(
    "matrix",
    "SELECT customer_id, "
    + ", ".join(
        f"(x_{c} - avg(x_{c}) OVER ()) / stddev_pop(x_{c}) OVER () AS {c}" for c in CLUSTER_FEATURES
    )
    + " FROM (SELECT customer_id, "
    + ", ".join(f"coalesce(y_{c}, median(y_{c}) OVER ()) AS x_{c}" for c in CLUSTER_FEATURES)
    + " FROM (SELECT customer_id, "
    + ", ".join(
        f"ln(1 + greatest(CAST({c} AS DOUBLE), 0)) AS y_{c}"
        if c in LOG_FEATURES
        else f"CAST({c} AS DOUBLE) AS y_{c}"
        for c in CLUSTER_FEATURES
    )
    + " FROM features))",
    ["features"],
)


@query(
    "cluster_matrix",
    BLOCKS.sql("SELECT customer_id, " + r4(*CLUSTER_FEATURES) + " FROM matrix", "matrix"),
)
def cluster_matrix(spark, sf_dir):
    return segmentation.cluster_matrix(stages.features(spark, sf_dir))


@query(
    "rfm_rule_segments",
    BLOCKS.sql("SELECT customer_id, rule_segment FROM rule_segments", "rule_segments"),
)
def rfm_rule_segments(spark, sf_dir):
    return segmentation.rfm_rule_segments(stages.features(spark, sf_dir))


BLOCKS.add(
    "cluster_names",
    """
    SELECT cluster, CASE WHEN count(*) OVER (PARTITION BY name) > 1
                         THEN name || ' #' || cluster ELSE name END AS segment_name
    FROM (SELECT cluster, rule_segment AS name, row_number() OVER (
                   PARTITION BY cluster ORDER BY count(*) DESC, rule_segment) AS place
          FROM rule_segments GROUP BY cluster, rule_segment) WHERE place = 1""",
    ["rule_segments"],
)
BLOCKS.add(
    "segments",
    "SELECT * FROM rule_segments JOIN cluster_names USING (cluster)",
    ["rule_segments", "cluster_names"],
)


@query(
    "name_clusters",
    BLOCKS.sql(
        "SELECT customer_id, CAST(cluster AS BIGINT) AS cluster, rule_segment, segment_name "
        "FROM segments",
        "segments",
    ),
)
def name_clusters(spark, sf_dir):
    return stages.rule_segments(spark, sf_dir)


@query(
    "segment_crosstab",
    BLOCKS.sql(
        "SELECT segment_name, "
        + ", ".join(
            f"count(*) FILTER (rule_segment = '{n}') AS \"{n}\"" for n in segmentation.RULE_NAMES
        )
        + " FROM segments GROUP BY segment_name",
        "segments",
    ),
)
def segment_crosstab(spark, sf_dir):
    return segmentation.segment_crosstab(stages.rule_segments(spark, sf_dir))


BLOCKS.add(
    "segment_data",
    """
    SELECT segments.*, features.* EXCLUDE (customer_id), coalesce(churn, 0) AS churn,
           coalesce(revenue_per_month * 12, 0) AS historical_value_proxy
    FROM segments LEFT JOIN features USING (customer_id) LEFT JOIN labels USING (customer_id)""",
    ["segments", "features", "labels"],
)


@query(
    "profile_joins",
    BLOCKS.sql(
        "SELECT customer_id, segment_name, CAST(churn AS BIGINT) AS churn, "
        + r4("historical_value_proxy", "net_revenue")
        + " FROM segment_data",
        "segment_data",
    ),
)
def profile_joins(spark, sf_dir):
    return stages.segment_data(spark, sf_dir).select(
        "customer_id", "segment_name", "churn", "historical_value_proxy", "net_revenue"
    )


def _profiles(group: str, extra: str = "") -> str:
    strategy = _cases(
        STRATEGY_BY_SEGMENT, f"split_part({group}, ' #', 1)", quoted([STRATEGY_FALLBACK])
    )
    return f"""
    SELECT {group}, {extra} count(*) AS n_customers, {r4(
        "sum(net_revenue) AS total_net_revenue", "avg(net_revenue) AS avg_net_revenue",
        "avg(historical_value_proxy) AS avg_value_proxy", "avg(churn) AS observed_churn_rate",
        "avg(recency_days) AS avg_recency_days", "avg(n_orders) AS avg_n_orders",
        "avg(aov) AS avg_aov", "avg(return_value_ratio) AS avg_return_ratio",
        "avg(recent_revenue_share) AS avg_recent_revenue_share",
        "avg(tenure_days) AS avg_tenure_days",
        "coalesce(sum(historical_value_proxy) FILTER (churn = 1), 0) AS revenue_at_risk_proxy",
        "round(count(*) / (SELECT count(*) FROM segment_data), 4) AS share_of_customers")},
        count(*) FILTER (churn = 1) AS n_churners, {strategy} AS recommended_strategy
    FROM segment_data GROUP BY {group}"""


@query(
    "segment_profiles",
    BLOCKS.sql(_profiles("segment_name", "CAST(min(cluster) AS BIGINT) AS cluster,"), "segment_data"),
)
def segment_profiles(spark, sf_dir):
    return segmentation.segment_profiles(stages.segment_data(spark, sf_dir))


@query("rule_segment_profiles", BLOCKS.sql(_profiles("rule_segment"), "segment_data"))
def rule_segment_profiles(spark, sf_dir):
    data = stages.segment_data(spark, sf_dir)
    return segmentation.segment_profiles(data, "rule_segment", None)


BLOCKS.add(
    "deviations",
    " UNION ALL ".join(
        f"""SELECT segment_name, '{c}' AS feature,
            (avg({c}) - (SELECT avg({c}) FROM segment_data))
            / (SELECT stddev_pop({c}) FROM segment_data) AS z
            FROM segment_data GROUP BY segment_name"""
        for c in CLUSTER_FEATURES
    ),
    ["segment_data"],
)
BLOCKS.add(
    "characteristics",
    """
    SELECT segment_name, place AS rank, feature,
           CASE WHEN z > 0 THEN 'higher' ELSE 'lower' END AS direction, round(z, 2) AS z_score
    FROM (SELECT *, row_number() OVER (PARTITION BY segment_name ORDER BY abs(z) DESC, feature)
            AS place FROM deviations WHERE z IS NOT NULL) WHERE place <= 5""",
    ["deviations"],
)


@query(
    "segment_characteristics",
    BLOCKS.sql(
        f"SELECT segment_name, rank, feature, direction, {r4('z_score')} FROM characteristics",
        "characteristics",
    ),
)
def segment_characteristics(spark, sf_dir):
    return segmentation.segment_characteristics(stages.segment_data(spark, sf_dir))


FLAGS = ", ".join(f"CAST(priority_rank <= {b} AS INTEGER) AS target_top_{b}" for b in BUDGETS)
BLOCKS.add(
    "priorities",
    f"""
    SELECT *, {FLAGS},
           CASE WHEN churn_probability > 0.67 THEN 'High' WHEN churn_probability > 0.34
                THEN 'Medium' ELSE 'Low' END AS risk_level
    FROM (SELECT value_risk.*, coalesce(segment_name, 'Unknown') AS segment_name,
                 row_number() OVER (ORDER BY revenue_at_risk DESC, customer_id) AS priority_rank
          FROM value_risk LEFT JOIN segments USING (customer_id))""",
    ["value_risk", "segments"],
)


@query(
    "priority_join",
    BLOCKS.sql(
        f"SELECT customer_id, {COHORT}, segment_name, CAST(recency_days AS BIGINT) AS "
        "recency_days, CAST(churn AS BIGINT) AS churn FROM priorities",
        "priorities",
    ),
)
def priority_join(spark, sf_dir):
    return prioritisation.priority_join(
        stages.value_risk(spark, sf_dir),
        stages.scored_test(spark, sf_dir),
        stages.rule_segments(spark, sf_dir),
    ).select("customer_id", "cohort_date", "segment_name", "recency_days", "churn")


@query(
    "priority_rank",
    BLOCKS.sql(
        f"SELECT customer_id, priority_rank, {r4('revenue_at_risk')} FROM priorities", "priorities"
    ),
)
def priority_rank(spark, sf_dir):
    ranked = prioritisation.priority_rank(stages.value_risk(spark, sf_dir))
    return ranked.select("customer_id", "priority_rank", "revenue_at_risk")


@query(
    "risk_level",
    BLOCKS.sql(
        f"SELECT customer_id, {r4('churn_probability')}, risk_level FROM priorities", "priorities"
    ),
)
def risk_level(spark, sf_dir):
    return stages.scored_test(spark, sf_dir).select(
        "customer_id",
        "churn_probability",
        prioritisation.risk_level(F.col("churn_probability")).alias("risk_level"),
    )


@query(
    "target_flags",
    BLOCKS.sql(
        "SELECT customer_id, "
        + ", ".join(f"CAST(target_top_{b} AS BIGINT) AS target_top_{b}" for b in BUDGETS)
        + " FROM priorities",
        "priorities",
    ),
)
def target_flags(spark, sf_dir):
    found = prioritisation.target_flags(stages.priorities(spark, sf_dir), BUDGETS)
    return found.select("customer_id", *[f"target_top_{b}" for b in BUDGETS])


@query(
    "retention_priorities",
    BLOCKS.sql(
        f"SELECT customer_id, {COHORT}, historical_orders, {r4(*VALUE_COLUMNS)}, "
        "CAST(recency_days AS BIGINT) AS recency_days, CAST(churn AS BIGINT) AS churn, "
        "segment_name, priority_rank, risk_level, "
        + ", ".join(f"CAST(target_top_{b} AS BIGINT) AS target_top_{b}" for b in BUDGETS)
        + " FROM priorities",
        "priorities",
    ),
)
def retention_priorities(spark, sf_dir):
    return prioritisation.retention_priorities(
        stages.value_risk(spark, sf_dir),
        stages.scored_test(spark, sf_dir),
        stages.rule_segments(spark, sf_dir),
        stages.PRIORITY,
    )


BLOCKS.add(
    "flagged",
    """SELECT *, expected_future_clv >= (SELECT quantile_cont(expected_future_clv, 0.75)
       FROM priorities) AS is_high_value FROM priorities""",
    ["priorities"],
)


@query(
    "high_value_flag",
    BLOCKS.sql("SELECT customer_id, is_high_value FROM flagged", "flagged"),
)
def high_value_flag(spark, sf_dir):
    flagged = prioritisation.high_value_flag(stages.priorities(spark, sf_dir))
    return flagged.select("customer_id", "is_high_value")


BLOCKS.add(
    "strategy_ranks",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS strategy, *,
            row_number() OVER (ORDER BY {score} DESC, customer_id) AS place,
            count(*) OVER () AS n FROM flagged"""
        for name, score in STRATEGY_SCORES.items()
    ),
    ["flagged"],
)
BLOCKS.add(
    "comparison",
    f"""
    SELECT strategy, budget, count(*) AS n_targeted,
           round(sum(revenue_at_risk), 2) AS revenue_at_risk_captured,
           round(sum(expected_future_clv), 2) AS expected_clv_captured,
           round(sum(actual_future_revenue), 2) AS observed_future_revenue_captured,
           CAST(sum(churn) AS BIGINT) AS actual_churners_captured,
           avg(churn) AS actual_churn_precision,
           count(*) FILTER (is_high_value) AS high_value_customers_captured
    FROM strategy_ranks, (VALUES {", ".join(f"({b})" for b in BUDGETS)}) AS v(budget)
    WHERE place <= budget GROUP BY ALL""",
    ["strategy_ranks"],
)
CAPTURED = (
    "n_targeted, actual_churners_captured, high_value_customers_captured, "
    + r4(
        "revenue_at_risk_captured", "expected_clv_captured", "observed_future_revenue_captured",
        "actual_churn_precision",
    )
)


@query(
    "metrics_at_k",
    BLOCKS.sql(
        f"SELECT strategy, {CAPTURED} FROM comparison WHERE budget = {BUDGETS[0]}", "comparison"
    ),
)
def metrics_at_k(spark, sf_dir):
    ranked = prioritisation.rank_strategies(stages.priorities(spark, sf_dir))
    return prioritisation.metrics_at_k(ranked, BUDGETS[:1]).drop("budget")


@query(
    "compare_strategies",
    BLOCKS.sql(
        f"SELECT strategy, CAST(budget AS BIGINT) AS budget, {CAPTURED} FROM comparison",
        "comparison",
    ),
)
def compare_strategies(spark, sf_dir):
    return prioritisation.compare_strategies(stages.priorities(spark, sf_dir), stages.PRIORITY)


@query(
    "strategy_totals",
    BLOCKS.sql(
        f"""
    SELECT count(*) AS n_customers, CAST(sum(churn) AS BIGINT) AS total_actual_churners,
           count(*) FILTER (is_high_value) AS total_high_value_customers, {r4(
        "round(sum(revenue_at_risk), 2) AS total_revenue_at_risk",
        "round(sum(expected_future_clv), 2) AS total_expected_clv",
        "round(sum(actual_future_revenue), 2) AS total_observed_future_revenue",
        "round(quantile_cont(expected_future_clv, 0.75), 2) AS high_value_threshold_clv")}
    FROM flagged""",
        "flagged",
    ),
)
def strategy_totals(spark, sf_dir):
    return prioritisation.strategy_totals(stages.priorities(spark, sf_dir), stages.PRIORITY)


@query(
    "capture_curve",
    BLOCKS.sql(
        f"""
    SELECT strategy, {r4("fraction", "round(sum(revenue_at_risk), 2) AS revenue_at_risk_captured")}
    FROM strategy_ranks,
         (VALUES {", ".join(f"({f}::DOUBLE)" for f in CAPTURE_FRACTIONS)}) AS v(fraction)
    WHERE place <= greatest(1, floor(n * fraction)) GROUP BY strategy, fraction""",
        "strategy_ranks",
    ),
)
def capture_curve(spark, sf_dir):
    ranked = stages.materialise(prioritisation.rank_strategies(stages.priorities(spark, sf_dir)))
    return prioritisation.capture_curve(ranked)


@query(
    "recency_rule_full",
    BLOCKS.sql(
        f"""
    SELECT count(*) FILTER (recency_days > 90) AS n_targeted,
           CAST(sum(churn) FILTER (recency_days > 90) AS BIGINT) AS actual_churners_captured,
           count(*) FILTER (recency_days > 90 AND is_high_value) AS high_value_customers_captured,
           {r4("count(*) FILTER (recency_days > 90) / count(*) AS coverage",
               "round(sum(revenue_at_risk) FILTER (recency_days > 90), 2) "
               "AS revenue_at_risk_captured",
               "avg(churn) FILTER (recency_days > 90) AS actual_churn_precision")}
    FROM flagged""",
        "flagged",
    ),
)
def recency_rule_full(spark, sf_dir):
    return prioritisation.recency_rule_full(stages.priorities(spark, sf_dir), stages.PRIORITY)


@query(
    "headline_uplift",
    BLOCKS.sql(
        f"""
    SELECT CAST({min(BUDGETS)} AS BIGINT) AS at_budget, {r4(
        "best AS recommended_revenue_at_risk_captured", "naive AS naive_revenue_at_risk_captured",
        "round(best - naive, 2) AS absolute_uplift", "(best - naive) / naive AS relative_uplift")}
    FROM (SELECT max(revenue_at_risk_captured) FILTER (strategy = 'revenue_at_risk') AS best,
                 max(revenue_at_risk_captured) FILTER (strategy = 'recency_rule') AS naive
          FROM comparison WHERE budget = {min(BUDGETS)})""",
        "comparison",
    ),
)
def headline_uplift(spark, sf_dir):
    comparison = prioritisation.compare_strategies(
        stages.priorities(spark, sf_dir), stages.PRIORITY
    )
    return prioritisation.headline_uplift(stages.materialise(comparison))


@query("prioritisation_report")
def prioritisation_report(spark, sf_dir):
    return prioritisation.prioritisation_report(stages.priorities(spark, sf_dir), stages.PRIORITY)


BLOCKS.add(
    "attributions",
    " UNION ALL ".join(
        f"""SELECT customer_id, '{c}' AS feature,
            coalesce(({c} - (SELECT avg({c}) FROM scored_test))
                     / (SELECT stddev_pop({c}) FROM scored_test), 0) AS shap_value
            FROM scored_test"""
        for c in stages.ATTRIBUTED
    ),
    ["scored_test"],
)
BLOCKS.add(
    "top_factors",
    """
    SELECT * FROM (
      SELECT customer_id, feature, shap_value, abs(shap_value) AS abs_shap,
             CASE WHEN shap_value > 0 THEN 'increases_risk' ELSE 'decreases_risk' END AS direction,
             row_number() OVER (PARTITION BY customer_id ORDER BY abs(shap_value) DESC, feature)
               AS rank
      FROM attributions) WHERE rank <= 5""",
    ["attributions"],
)


@query(
    "global_importance",
    BLOCKS.sql(
        f"""
    SELECT feature, {r4("mean_abs_shap")}, row_number() OVER (ORDER BY mean_abs_shap DESC, feature)
             AS rank
    FROM (SELECT feature, avg(abs(shap_value)) AS mean_abs_shap FROM attributions GROUP BY feature)
    """,
        "attributions",
    ),
)
def global_importance(spark, sf_dir):
    return explain.global_importance(stages.attributions(spark, sf_dir), stages.ATTRIBUTED)


@query(
    "customer_top_factors",
    BLOCKS.sql(
        f"SELECT customer_id, rank, feature, direction, {r4('shap_value', 'abs_shap')} "
        "FROM top_factors",
        "top_factors",
    ),
)
def customer_top_factors(spark, sf_dir):
    return stages.factors(spark, sf_dir)


BLOCKS.add(
    "segment_factors",
    """
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY segment_name ORDER BY abs_mean_shap DESC, feature)
        AS rank
      FROM (SELECT segment_name, feature, abs(avg(shap_value)) AS abs_mean_shap,
                   avg(abs(shap_value)) AS mean_abs_shap
            FROM attributions JOIN segments USING (customer_id) GROUP BY ALL)) WHERE rank <= 5""",
    ["attributions", "segments"],
)


@query(
    "segment_factors",
    BLOCKS.sql(
        f"SELECT segment_name, rank, feature, {r4('abs_mean_shap', 'mean_abs_shap')} "
        "FROM segment_factors",
        "segment_factors",
    ),
)
def segment_factors(spark, sf_dir):
    return explain.segment_factors(
        stages.attributions(spark, sf_dir), stages.ATTRIBUTED, stages.rule_segments(spark, sf_dir)
    )


BLOCKS.add(
    "dominant",
    """
    SELECT priorities.*, coalesce(feature, 'unknown') AS dominant_risk_factor,
           coalesce(direction, 'unknown') AS dominant_direction
    FROM priorities LEFT JOIN (SELECT customer_id, feature, direction FROM top_factors
                               WHERE rank = 1) USING (customer_id)""",
    ["priorities", "top_factors"],
)
BY_FACTOR = _cases(ACTION_BY_FACTOR, "dominant_risk_factor")
BY_SEGMENT = _cases(ACTION_BY_SEGMENT, "segment_name")
BLOCKS.add(
    "recommended",
    f"""
    SELECT *, coalesce({BY_FACTOR}, {BY_SEGMENT}, {quoted([ACTION_FALLBACK])}) AS primary_action,
           CASE WHEN {BY_FACTOR} IS NOT NULL
                  THEN 'dominant risk factor: ' || dominant_risk_factor
                WHEN {BY_SEGMENT} IS NOT NULL THEN 'segment: ' || segment_name
                ELSE 'no specific signal' END AS rationale
    FROM dominant""",
    ["dominant"],
)


@query(
    "dominant_factor",
    BLOCKS.sql(
        "SELECT customer_id, dominant_risk_factor, dominant_direction FROM dominant", "dominant"
    ),
)
def dominant_factor(spark, sf_dir):
    return recommendations.dominant_factor(
        stages.priorities(spark, sf_dir), stages.factors(spark, sf_dir)
    ).select("customer_id", "dominant_risk_factor", "dominant_direction")


@query(
    "assign_action",
    BLOCKS.sql("SELECT customer_id, primary_action, rationale FROM recommended", "recommended"),
)
def assign_action(spark, sf_dir):
    joined = recommendations.dominant_factor(
        stages.priorities(spark, sf_dir), stages.factors(spark, sf_dir)
    )
    return recommendations.assign_action(joined).select(
        "customer_id", "primary_action", "rationale"
    )


@query(
    "recommendation_table",
    BLOCKS.sql(
        "SELECT customer_id, segment_name, risk_level, priority_rank, dominant_risk_factor, "
        "dominant_direction, primary_action, rationale, "
        + r4("churn_probability", "expected_future_clv", "revenue_at_risk")
        + " FROM recommended",
        "recommended",
    ),
)
def recommendation_table(spark, sf_dir):
    return recommendations.recommendation_table(
        stages.priorities(spark, sf_dir), stages.factors(spark, sf_dir)
    )


BLOCKS.add(
    "actions",
    """
    SELECT primary_action AS action, count(*) AS n_customers,
           round(sum(expected_future_clv), 2) AS total_expected_clv,
           round(sum(revenue_at_risk), 2) AS total_revenue_at_risk,
           round(avg(churn_probability), 4) AS mean_churn_probability
    FROM recommended GROUP BY primary_action""",
    ["recommended"],
)
BLOCKS.add(
    "action_segments",
    """
    SELECT * FROM (
      SELECT primary_action AS action, segment_name AS segment, count(*) AS customers,
             row_number() OVER (PARTITION BY primary_action ORDER BY count(*) DESC, segment_name)
               AS rank
      FROM recommended GROUP BY primary_action, segment_name) WHERE rank <= 3""",
    ["recommended"],
)
ACTIONS = "action, n_customers, " + r4(
    "total_expected_clv", "total_revenue_at_risk", "mean_churn_probability"
)


@query("action_summary", BLOCKS.sql(f"SELECT {ACTIONS} FROM actions", "actions"))
def action_summary(spark, sf_dir):
    return recommendations.action_summary(stages.recommendations(spark, sf_dir))


@query("action_top_segments", BLOCKS.sql("SELECT * FROM action_segments", "action_segments"))
def action_top_segments(spark, sf_dir):
    return recommendations.action_top_segments(stages.recommendations(spark, sf_dir))


@query("recommendations_report")
def recommendations_report(spark, sf_dir):
    return recommendations.recommendations_report(stages.recommendations(spark, sf_dir))


BLOCKS.add(
    "recommended_flagged",
    "SELECT recommended.*, is_high_value FROM recommended JOIN (SELECT customer_id, "
    "is_high_value FROM flagged) USING (customer_id)",
    ["recommended", "flagged"],
)


@query(
    "exec_kpis",
    BLOCKS.sql(
        f"""
    SELECT count(*) AS total_customers,
           count(*) FILTER (churn_probability < 0.5) AS active_customers,
           count(*) FILTER (churn_probability >= 0.5) AS customers_at_risk,
           count(*) FILTER (churn_probability >= 0.5 AND is_high_value) AS high_value_at_risk,
           {r4("round(sum(revenue_at_risk), 2) AS revenue_at_risk",
               "round(sum(expected_future_clv) FILTER (churn_probability >= 0.5), 2) "
               "AS clv_at_risk")}
    FROM recommended_flagged""",
        "recommended_flagged",
    ),
)
def exec_kpis(spark, sf_dir):
    return views.exec_kpis(stages.recommendations(spark, sf_dir))


@query(
    "risk_distribution",
    BLOCKS.sql(
        """
    SELECT CAST(position AS BIGINT) AS position, level AS risk_level,
           count(customer_id) AS n_customers
    FROM (VALUES (1, 'Low'), (2, 'Medium'), (3, 'High')) AS v(position, level)
    LEFT JOIN recommended ON risk_level = level GROUP BY ALL""",
        "recommended",
    ),
)
def risk_distribution(spark, sf_dir):
    return views.risk_distribution(stages.recommendations(spark, sf_dir))


SEGMENT_RISK = r4("round(sum(revenue_at_risk), 2) AS revenue_at_risk")


@query(
    "risk_by_segment",
    BLOCKS.sql(
        f"SELECT segment_name, {SEGMENT_RISK} FROM recommended GROUP BY segment_name", "recommended"
    ),
)
def risk_by_segment(spark, sf_dir):
    return views.risk_by_segment(stages.recommendations(spark, sf_dir))


SHOWN_SCORES = r4("churn_probability", "expected_future_clv", "revenue_at_risk")


@query(
    "top_customers",
    BLOCKS.sql(
        f"SELECT customer_id, segment_name, risk_level, primary_action, {SHOWN_SCORES} "
        "FROM recommended WHERE priority_rank <= 10",
        "recommended",
    ),
)
def top_customers(spark, sf_dir):
    return views.top_customers(stages.recommendations(spark, sf_dir))


@query(
    "top_actions",
    BLOCKS.sql(
        f"SELECT {ACTIONS} FROM (SELECT * FROM actions ORDER BY total_revenue_at_risk DESC, action "
        "LIMIT 3)",
        "actions",
    ),
)
def top_actions(spark, sf_dir):
    return views.top_actions(stages.recommendations(spark, sf_dir))


@query(
    "customer_search",
    BLOCKS.sql(
        f"SELECT customer_id, segment_name, risk_level, {SHOWN_SCORES} FROM (SELECT * FROM "
        "recommended WHERE risk_level IN ('Medium', 'High') "
        "AND segment_name = (SELECT min(segment_name) FROM recommended) "
        "AND contains(CAST(customer_id AS VARCHAR), '1') ORDER BY priority_rank LIMIT 500)",
        "recommended",
    ),
)
def customer_search(spark, sf_dir):
    found = stages.recommendations(spark, sf_dir)
    segment = found.agg(F.min("segment_name")).head()[0]
    return views.customer_search(found, ["Medium", "High"], [segment], "1")


PROFILE_WHOLE = ["recency_days", "n_orders", "tenure_days", "active_months"]


@query(
    "customer_detail",
    BLOCKS.sql(
        f"""
    SELECT customer_id, segment_name, risk_level, priority_rank, dominant_risk_factor,
           dominant_direction, primary_action, rationale, {SHOWN_SCORES},
           {", ".join(f"CAST(features.{c} AS BIGINT) AS {c}" for c in PROFILE_WHOLE)},
           {r4("features.net_revenue AS net_revenue", "features.aov AS aov",
               "features.avg_interval AS avg_interval",
               "features.return_value_ratio AS return_value_ratio",
               "top_factors.shap_value AS shap_value")},
           features.country_grouped, top_factors.rank, top_factors.feature, top_factors.direction
    FROM recommended LEFT JOIN features USING (customer_id)
    LEFT JOIN top_factors USING (customer_id) WHERE priority_rank = 1""",
        "recommended",
        "features",
        "top_factors",
    ),
)
def customer_detail(spark, sf_dir):
    found = stages.recommendations(spark, sf_dir)
    first = found.filter(F.col("priority_rank") == 1).head()["customer_id"]
    return views.customer_detail(
        first, found, stages.factors(spark, sf_dir), stages.features(spark, sf_dir)
    )


@query(
    "segment_overview",
    BLOCKS.sql(
        "SELECT segment_name, n_customers, total_net_revenue, avg_value_proxy, "
        "observed_churn_rate, revenue_at_risk_proxy, recommended_strategy FROM ("
        + _profiles("segment_name")
        + ")",
        "segment_data",
    ),
)
def segment_overview(spark, sf_dir):
    return views.segment_overview(
        segmentation.segment_profiles(stages.segment_data(spark, sf_dir))
    )


@query(
    "segment_detail",
    BLOCKS.sql(
        f"""
    SELECT rank, c.feature, direction, f.feature AS risk_factor,
           (SELECT {_cases(STRATEGY_BY_SEGMENT, "split_part(min(segment_name), ' #', 1)")}
            FROM segments) AS recommended_strategy
    FROM (SELECT * FROM characteristics
          WHERE segment_name = (SELECT min(segment_name) FROM segments)) c
    FULL JOIN (SELECT * FROM segment_factors
               WHERE segment_name = (SELECT min(segment_name) FROM segments)) f USING (rank)""",
        "characteristics",
        "segment_factors",
        "segments",
    ),
)
def segment_detail(spark, sf_dir):
    segments = stages.rule_segments(spark, sf_dir)
    shap = stages.attributions(spark, sf_dir)
    return views.segment_detail(
        segments.agg(F.min("segment_name")).head()[0],
        segmentation.segment_characteristics(stages.segment_data(spark, sf_dir)),
        explain.segment_factors(shap, stages.ATTRIBUTED, segments),
    )


@query(
    "budget_comparison",
    BLOCKS.sql(
        "SELECT strategy, n_targeted, high_value_customers_captured, "
        + r4("revenue_at_risk_captured", "expected_clv_captured",
             "observed_future_revenue_captured")
        + " FROM comparison WHERE budget = 250",
        "comparison",
    ),
)
def budget_comparison(spark, sf_dir):
    return views.budget_comparison(
        prioritisation.compare_strategies(stages.priorities(spark, sf_dir), stages.PRIORITY), 250
    )


@query(
    "priority_mix",
    BLOCKS.sql(
        f"SELECT segment_name, {SEGMENT_RISK} FROM priorities WHERE priority_rank <= 100 "
        "GROUP BY segment_name",
        "priorities",
    ),
)
def priority_mix(spark, sf_dir):
    return views.priority_mix(stages.priorities(spark, sf_dir), 100)


@query(
    "action_list",
    BLOCKS.sql(
        f"""
    SELECT {ACTIONS}, top_segments
    FROM (SELECT * FROM actions ORDER BY total_revenue_at_risk DESC, action LIMIT 8)
    JOIN (SELECT action, string_agg(segment || ' (' || customers || ')', ', ' ORDER BY rank)
            AS top_segments FROM action_segments GROUP BY action) USING (action)""",
        "actions",
        "action_segments",
    ),
)
def action_list(spark, sf_dir):
    return views.action_list(stages.recommendations(spark, sf_dir))
