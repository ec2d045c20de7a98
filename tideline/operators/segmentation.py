"""Customer segments: clusters, business rules, names and profiles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.ordering import global_rank
from tideline.functions.scalars import lookup, rounded
from tideline.operators.clustering import (
    fit_kmeans_all,
    fit_mixtures,
    fit_ward,
    mixture_assigned,
    nearest,
    silhouettes,
    ward_assigned,
)
from tideline.operators.modelling import impute_median, standard_scale
from tideline.params import STRATEGY_FALLBACK, VALUE_PROXY_DEFINITION, SegmentationParams
from tideline.session import materialise

QUINTILES = 5
RULE_NAMES = (
    "Champions",
    "Loyal customers",
    "High-value at risk",
    "New customers",
    "Occasional buyers",
    "High-return customers",
    "Lost customers",
)
SCORED = {"r": "recency_days", "f": "n_orders", "m": "net_revenue"}


@dataclass(frozen=True)
class SegmentResult:
    model: str
    k: int
    silhouette: float
    segments: DataFrame
    candidates: DataFrame
    report: DataFrame


def cluster_matrix(
    features: DataFrame, params: SegmentationParams = SegmentationParams()
) -> DataFrame:
    """Cluster features after logarithms, median imputation and standardisation."""
    columns = list(params.cluster_features)
    chosen = features.select("customer_id", *[F.col(c).cast("double") for c in columns])
    logs = {
        c: F.log1p(F.when(F.col(c) < 0, 0.0).otherwise(F.col(c)))
        for c in params.log_features
        if c in columns
    }
    logged = chosen.withColumns(logs)
    filled = materialise(impute_median(logged, logged, columns))
    return standard_scale(filled, filled, columns)


def as_points(matrix: DataFrame, params: SegmentationParams = SegmentationParams()) -> DataFrame:
    return matrix.select("customer_id", F.array(*params.cluster_features).alias("features"))


def with_kmeans(points: DataFrame, ks: Sequence[int], params: SegmentationParams) -> DataFrame:
    """The cheapest of several starts for each k, all fitted in the same scans."""
    fits = fit_kmeans_all(points, ks, params.kmeans_restarts, params.seed)
    return points.withColumns({f"kmeans_{k}": nearest(fits[k].centres) for k in ks})


def with_gmm(points: DataFrame, ks: Sequence[int], params: SegmentationParams) -> DataFrame:
    """A Gaussian mixture with full covariances for each k, all fitted in the same scans."""
    fits = fit_mixtures(points, ks, params.seed, params.gmm_max_iter, params.gmm_tolerance)
    return mixture_assigned(points, {f"gmm_{k}": fit for k, fit in fits.items()})


def with_hierarchical(points: DataFrame, ks: Sequence[int], params: SegmentationParams) -> DataFrame:
    """Ward's hierarchy, cut at each k."""
    return ward_assigned(points, fit_ward(points), ks, "hierarchical_")


CLUSTERERS = {"kmeans": with_kmeans, "gmm": with_gmm, "hierarchical": with_hierarchical}


def segment_grid(points: DataFrame, params: SegmentationParams = SegmentationParams()):
    """Every model at every k; returns the candidates and the best (model, k, score, rows)."""
    assigned = points
    for name in params.models:
        assigned = CLUSTERERS[name](assigned, params.k_range, params)
    assigned = materialise(assigned)
    named = [(name, k) for k in params.k_range for name in params.models]
    scores = silhouettes(assigned, [f"{name}_{k}" for name, k in named], params.silhouette_sample)
    found = [(n, k, scores[f"{n}_{k}"].score, scores[f"{n}_{k}"].error) for n, k in named if f"{n}_{k}" in scores]
    if not found:
        raise RuntimeError("no clustering gave two clusters")
    name, k, score, _ = max(found, key=lambda c: c[2])
    frame = points.sparkSession.createDataFrame(
        found, "model string, k int, silhouette double, standard_error double"
    ).withColumns({c: rounded(F.col(c)) for c in ("silhouette", "standard_error")})
    best = assigned.select("customer_id", F.col(f"{name}_{k}").alias("cluster"))
    return frame, (name, k, score, best)


def _stack_scores(features: DataFrame) -> DataFrame:
    entries = [
        F.struct(
            F.lit(score).alias("score"),
            F.col(column).cast("double").alias("value"),
            F.col("customer_id"),
        )
        for score, column in SCORED.items()
    ]
    return features.select(F.inline(F.array(*entries)))


def rfm_scores(features: DataFrame, params: SegmentationParams = SegmentationParams()) -> DataFrame:
    """Add r_score, f_score and m_score: quintiles of the first rank.

    Ties in a score go by customer. Row i of n (from 0) is in quintile
    ceil(5 i / (n - 1)) - 1, at least 0, so quintile q starts one row after
    q (n - 1) / 5 rounded down. The rows at those places are looked up in one
    layout of all three scores, and each customer is compared with them.
    """
    ranked = global_rank(
        _stack_scores(features), [F.col("value"), F.col("customer_id")], "place", by=["score"]
    )
    n = features.count()
    starts = [(q * (n - 1)) // QUINTILES + 2 for q in range(1, QUINTILES)]
    rows = ranked.filter(F.col("place").isin(starts)).collect()
    at = {(r["score"], r["place"]): (r["value"], r["customer_id"]) for r in rows}

    id_type = features.schema["customer_id"].dataType

    def quintile(score: str) -> Column:
        place = F.struct(F.col(SCORED[score]).cast("double"), F.col("customer_id"))

        def cut(start: int) -> Column:
            value, customer = at[score, start]
            return F.struct(F.lit(value), F.lit(customer).cast(id_type))

        reached = [(place >= cut(s)).cast("int") for s in starts if (score, s) in at]
        return sum(reached, F.lit(0))

    return features.withColumns(
        {
            "r_score": F.lit(params.recency_score_top) - quintile("r"),
            "f_score": quintile("f") + 1,
            "m_score": quintile("m") + 1,
        }
    )


def rfm_rule_segments(
    features: DataFrame, params: SegmentationParams = SegmentationParams()
) -> DataFrame:
    """(customer_id, rule_segment): the first rule that holds."""
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    rule = (
        F.when(
            F.col("return_value_ratio") > params.high_return_threshold, "High-return customers"
        )
        .when((F.col("tenure_days") < params.new_customer_days) & (f <= 2), "New customers")
        .when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((m >= 4) & (r <= 2), "High-value at risk")
        .when(r <= 1, "Lost customers")
        .when((f <= 2) & (m <= 2), "Occasional buyers")
        .when((r >= 3) & (f >= 3), "Loyal customers")
        .otherwise("Occasional buyers")
    )
    return rfm_scores(features, params).select("customer_id", rule.alias("rule_segment"))


def name_clusters(segments: DataFrame) -> DataFrame:
    """Name each cluster after its commonest rule; clusters that share a name get a number."""
    counts = segments.groupBy("cluster", "rule_segment").agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by("rule_segment", F.struct(-F.col("n"), F.col("rule_segment")))
    majority = counts.groupBy("cluster").agg(best.alias("_name"))
    shared = F.count(F.lit(1)).over(W.partitionBy("_name")) > 1
    names = majority.select(
        "cluster",
        F.when(shared, F.concat("_name", F.lit(" #"), F.col("cluster").cast("string")))
        .otherwise(F.col("_name"))
        .alias("segment_name"),
    )
    # One row per cluster.
    return segments.join(F.broadcast(names), "cluster").select(
        "customer_id", "cluster", "rule_segment", "segment_name"
    )


def segment_crosstab(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_name").pivot("rule_segment", list(RULE_NAMES)).count().fillna(0)


def cluster_sizes(segments: DataFrame) -> DataFrame:
    return segments.groupBy("segment_name").agg(F.count(F.lit(1)).alias("n_customers"))


def segment_customers(
    features: DataFrame, params: SegmentationParams = SegmentationParams()
) -> SegmentResult:
    points = materialise(as_points(cluster_matrix(features, params), params))
    candidates, (name, k, score, assigned) = segment_grid(points, params)
    rules = rfm_rule_segments(features, params)
    segments = materialise(
        name_clusters(assigned.select("customer_id", "cluster").join(rules, "customer_id"))
    )
    report = segment_model_report(name, k, score, candidates, segments)
    return SegmentResult(name, k, score, segments, candidates, report)


def segment_model_report(
    name: str, k: int, score: float, candidates: DataFrame, segments: DataFrame
) -> DataFrame:
    ordered = F.array_sort(
        F.collect_list(F.struct((-F.col("silhouette")).alias("order"), "model", "k", "silhouette"))
    )
    shown = F.transform(
        ordered,
        lambda c: F.struct(
            c["model"].alias("model"), c["k"].alias("k"), c["silhouette"].alias("silhouette")
        ),
    )
    sizes, crossed = cluster_sizes(segments), segment_crosstab(segments)
    return candidates.agg(shown.alias("candidates")).select(
        F.lit(name).alias("chosen_model"),
        F.lit(k).alias("chosen_k"),
        F.lit(round(score, 4)).alias("chosen_silhouette"),
        "candidates",
        sizes.agg(F.map_from_entries(F.collect_list(F.struct("segment_name", "n_customers"))))
        .scalar()
        .alias("cluster_sizes"),
        crossed.agg(F.collect_list(F.struct(*crossed.columns)))
        .scalar()
        .alias("cluster_vs_rule_crosstab"),
    )


def profile_joins(
    segments: DataFrame, features: DataFrame, labels: DataFrame, scores: DataFrame
) -> DataFrame:
    return (
        segments.join(features, "customer_id", "left")
        .join(labels.select("customer_id", "churn", "future_revenue"), "customer_id", "left")
        .join(scores.select("customer_id", "historical_value_proxy"), "customer_id", "left")
        .fillna({"churn": 0, "historical_value_proxy": 0.0})
    )


def segment_profiles(
    data: DataFrame,
    group: str = "segment_name",
    cluster: str | None = "cluster",
    params: SegmentationParams = SegmentationParams(),
) -> DataFrame:
    """Business figures per group, its share of customers and its strategy."""
    churned = F.col("churn") == 1
    means = {
        "avg_net_revenue": "net_revenue",
        "avg_value_proxy": "historical_value_proxy",
        "observed_churn_rate": "churn",
        "avg_recency_days": "recency_days",
        "avg_n_orders": "n_orders",
        "avg_aov": "aov",
        "avg_return_ratio": "return_value_ratio",
        "avg_recent_revenue_share": "recent_revenue_share",
        "avg_tenure_days": "tenure_days",
    }
    extra = [F.min(cluster).alias(cluster)] if cluster else []
    # The data has one row per customer, so rows are distinct customers.
    profiles = data.groupBy(group).agg(
        F.count("customer_id").alias("n_customers"),
        F.sum("net_revenue").alias("total_net_revenue"),
        *[F.avg(column).alias(name) for name, column in means.items()],
        *extra,
        F.coalesce(F.sum(F.when(churned, F.col("historical_value_proxy"))), F.lit(0.0)).alias(
            "revenue_at_risk_proxy"
        ),
        F.count_if(churned).alias("n_churners"),
    )
    everyone = data.agg(F.count("customer_id")).scalar()
    base_name = F.element_at(F.split(F.col(group), " #"), 1)
    return profiles.withColumns(
        {
            "share_of_customers": F.round(F.col("n_customers") / everyone, 4),
            "recommended_strategy": F.coalesce(
                lookup(params.strategies, base_name), F.lit(STRATEGY_FALLBACK)
            ),
        }
    ).orderBy(F.col("revenue_at_risk_proxy").desc(), group)


def segment_characteristics(
    data: DataFrame,
    group: str = "segment_name",
    params: SegmentationParams = SegmentationParams(),
    top: int = 5,
) -> DataFrame:
    """The features whose group mean lies furthest from the overall mean."""
    columns = [c for c in params.cluster_features if c in data.columns]
    overall = data.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    ).scalar()
    means = data.groupBy(group).agg(*[F.avg(c).alias(c) for c in columns]).withColumn("_all", overall)
    entries = [
        F.struct(
            F.lit(c).alias("feature"),
            F.try_divide(F.col(c) - F.col(f"_all.m_{c}"), F.col(f"_all.s_{c}")).alias("z"),
        )
        for c in columns
    ]
    stacked = means.select(group, F.explode(F.array(*entries)).alias("_e")).select(group, "_e.*")
    place = F.row_number().over(W.partitionBy(group).orderBy(F.abs("z").desc(), "feature"))
    return (
        stacked.filter(F.col("z").isNotNull())
        .withColumn("rank", place)
        .filter(F.col("rank") <= top)
        .select(
            group,
            "rank",
            "feature",
            F.when(F.col("z") > 0, "higher").otherwise("lower").alias("direction"),
            F.round("z", 2).alias("z_score"),
        )
    )


def segmentation_report(
    result: SegmentResult, data: DataFrame, params: SegmentationParams = SegmentationParams()
) -> DataFrame:
    """One row: the model report with both profiles and the characteristics folded in."""

    def rows_of(df: DataFrame) -> Column:
        shown = [
            rounded(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else f.name
            for f in df.schema.fields
        ]
        return df.agg(F.collect_list(F.struct(*shown))).scalar()

    clusters = segment_profiles(data, params=params)
    return result.report.select(
        "*",
        F.lit(VALUE_PROXY_DEFINITION).alias(
            "value_proxy_definition"
        ),
        rows_of(clusters).alias("segments"),
        rows_of(segment_profiles(data, "rule_segment", None, params)).alias("rule_based_segments"),
        rows_of(segment_characteristics(data, params=params)).alias(
            "key_behavioural_characteristics"
        ),
    ).withColumn("n_segments", F.size("segments"))
