"""Queries on fitted models: classifiers, regressors, clusters and their explanation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tideline.operators import churn, clustering, explain, modelling, segmentation, value
from tideline.params import CLUSTER_FEATURES
from tideline.plans import stages, targeting  # noqa: F401 - targeting adds SQL blocks
from tideline.plans.blocks import BLOCKS, NUMERIC_FEATURES
from tideline.plans.registry import query, r4
from tideline.session import new_path
from tideline.sources import sinks
from tideline.sources.star_schema import read_table

TEST_COHORT = f"TIMESTAMP '{stages.COHORTS.test_cohorts[0]}'"


FEATURES_SQL = BLOCKS.sql(
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{kind}' AS kind, count({c}) AS n FROM p_panel"
        for kind, names in (("numeric", NUMERIC_FEATURES), ("categorical", ["country_grouped"]))
        for c in names
    )
    + ")",
    "p_panel",
)


@query("feature_selection", FEATURES_SQL)
def feature_selection(spark, sf_dir):
    columns = churn.churn_columns(stages.panel(spark, sf_dir))
    panel = stages.panel(spark, sf_dir)
    entries = [
        F.struct(F.lit(name).alias("feature"), F.lit(kind).alias("kind"), F.count(name).alias("n"))
        for kind, names in (("numeric", columns.numeric), ("categorical", columns.categorical))
        for name in names
    ]
    return panel.agg(F.array(*entries).alias("_e")).select(F.inline("_e"))


@query(
    "one_hot",
    "SELECT c_custkey AS customer_id, n_name AS country, "
    "CASE WHEN n_regionkey <> 0 THEN n_name ELSE 'none' END AS encoded "
    "FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def one_hot(spark, sf_dir):
    """Fitted without one region's countries, which then have to come out as all zeros."""
    nation = read_table(spark, sf_dir, "nation")
    customer = read_table(spark, sf_dir, "customer")
    homes = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"), F.col("n_name").alias("country"), "n_regionkey"
    )
    fitted = Pipeline(stages=modelling.one_hot_stages(["country"])).fit(
        homes.filter("n_regionkey <> 0")
    )
    labels = F.array(*[F.lit(x) for x in fitted.stages[0].labelsArray[0]])
    place = F.array_position(vector_to_array("country_is"), 1.0)
    encoded = F.when(place > 0, F.try_element_at(labels, place.cast("int"))).otherwise("none")
    return fitted.transform(homes).select("customer_id", "country", encoded.alias("encoded"))


def _classifier(name: str):
    def build(spark, sf_dir):
        model = stages.churn_model(spark, sf_dir, name)
        test = stages.split(spark, sf_dir, stages.COHORTS.test_cohorts)
        return churn.score(model, test, stages.COHORTS)

    return build


query("logistic_regression")(_classifier("logistic_regression"))
query("random_forest_clf")(_classifier("random_forest"))
query("gbt_clf")(_classifier("gradient_boosting"))


def _regressor(name: str):
    def build(spark, sf_dir):
        model = stages.value_model(spark, sf_dir, name)
        test = stages.split(spark, sf_dir, stages.COHORTS.test_cohorts)
        return value.clv_predictions(model, test, stages.VALUE)

    return build


query("ridge")(_regressor("ridge"))
query("random_forest_reg")(_regressor("random_forest"))
query("gbt_reg")(_regressor("gradient_boosting"))
query("tweedie_boost")(_regressor("tweedie"))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    return stages.churn_result(spark, sf_dir).importance


@query("model_selection")
def model_selection(spark, sf_dir):
    result = stages.churn_result(spark, sf_dir)
    return result.metrics.withColumn("chosen", F.col("model") == result.chosen_model)


@query("calibrate")
def calibrate(spark, sf_dir):
    predictions = stages.churn_result(spark, sf_dir).predictions
    return predictions.select("customer_id", churn.RAW, churn.CALIBRATED)


@query("churn_predictions")
def churn_predictions(spark, sf_dir):
    return stages.churn_result(spark, sf_dir).predictions


@query("churn_metrics_report")
def churn_metrics_report(spark, sf_dir):
    return sinks.as_json(stages.churn_result(spark, sf_dir).report)


@query("model_store")
def model_store(spark, sf_dir):
    """Probabilities of the model after saving and loading it, beside those before."""
    result = stages.churn_result(spark, sf_dir)
    path = new_path(spark, "churn-model")
    sinks.save_model(result.model, path)
    test = stages.split(spark, sf_dir, stages.COHORTS.test_cohorts)
    loaded = churn.score(sinks.load_model(path), test, stages.COHORTS, "after")
    before = churn.score(result.model, test, stages.COHORTS, "before")
    return before.join(loaded.drop("y_true"), ["customer_id", "cohort_date"])


@query("clv_selection")
def clv_selection(spark, sf_dir):
    result = stages.value_result(spark, sf_dir)
    return result.metrics.withColumn("chosen", F.col("model") == result.chosen_model)


@query("clv_predictions")
def clv_predictions(spark, sf_dir):
    return stages.value_result(spark, sf_dir).predictions


@query("clv_importance")
def clv_importance(spark, sf_dir):
    return stages.value_result(spark, sf_dir).importance


@query("clv_metrics_report")
def clv_metrics_report(spark, sf_dir):
    return sinks.as_json(stages.value_result(spark, sf_dir).report)


@query("modelled_value_and_risk")
def modelled_value_and_risk(spark, sf_dir):
    """Value and risk from both fitted models."""
    return stages.modelled_risk(spark, sf_dir)


@query("modelled_recommendations")
def modelled_recommendations(spark, sf_dir):
    """One row per test customer: rank by modelled risk, real contributions, action."""
    return stages.modelled_recommendations(spark, sf_dir)


@query(
    "modelled_chain_agrees",
    BLOCKS.sql(
        f"""SELECT count(*) AS n_customers, count(*) AS last_rank, TRUE AS same_risk
        FROM p_panel WHERE cohort_date = {TEST_COHORT}""",
        "p_panel",
    ),
)
def modelled_chain_agrees(spark, sf_dir):
    """Customers and last rank of the modelled chain, and whether its risk is that of the models."""
    advice = stages.modelled_recommendations(spark, sf_dir)
    risk = stages.modelled_risk(spark, sf_dir).agg(F.sum("revenue_at_risk")).scalar()
    return advice.agg(
        F.count_distinct("customer_id").alias("n_customers"),
        F.max("priority_rank").alias("last_rank"),
        F.sum("revenue_at_risk").alias("_risk"),
    ).select("n_customers", "last_rank", (F.abs(F.col("_risk") - risk) < 0.01).alias("same_risk"))


def points(spark, sf_dir):
    matrix = segmentation.cluster_matrix(stages.features(spark, sf_dir))
    return stages.stage_table(spark, sf_dir, "points", lambda: segmentation.as_points(matrix))


def _clusters(name: str):
    def build(spark, sf_dir):
        found = segmentation.CLUSTERERS[name](points(spark, sf_dir), (3,), stages.SEGMENTS)
        return found.select("customer_id", F.col(f"{name}_3").alias("cluster"))

    return build


CLUSTERINGS = {name: query(name)(_clusters(name)) for name in segmentation.CLUSTERERS}


def _silhouette_sql(labels: str, cluster: str) -> str:
    return f"""
    SELECT '{labels}' AS labels, count(*) AS n_customers, {r4("avg(s) AS silhouette")} FROM (
      SELECT id, CASE WHEN max(n) FILTER (own) = 1 THEN 0
        ELSE (min(d / n) FILTER (NOT own) - max(d / (n - 1)) FILTER (own))
          / greatest(min(d / n) FILTER (NOT own), max(d / (n - 1)) FILTER (own)) END AS s
      FROM (
        SELECT a.customer_id AS id, a.part = b.part AS own, count(*) AS n,
          sum(sqrt({" + ".join(f"(a.{c} - b.{c}) ** 2" for c in CLUSTER_FEATURES)})) AS d
        FROM (SELECT matrix.*, {cluster} AS part FROM matrix JOIN rule_segments USING (customer_id)) AS a,
          (SELECT matrix.*, {cluster} AS part FROM matrix JOIN rule_segments USING (customer_id)) AS b
        GROUP BY a.customer_id, b.part, a.part = b.part
      ) GROUP BY id)"""


@query(
    "silhouette",
    BLOCKS.sql(
        _silhouette_sql("frequency", "rule_segments.cluster")
        + " UNION ALL "
        + _silhouette_sql("rule", "rule_segment"),
        "matrix",
        "rule_segments",
    ),
)
def silhouette(spark, sf_dir):
    """Mean silhouette of two assignments that SQL can state: by order frequency and by rule."""
    rules = stages.rule_segments(spark, sf_dir)
    number = F.array_position(F.array(*[F.lit(n) for n in segmentation.RULE_NAMES]), F.col("rule_segment"))
    labelled = rules.select("customer_id", F.col("cluster").alias("frequency"), number.cast("int").alias("rule"))
    assigned = stages.materialise(points(spark, sf_dir).join(labelled, "customer_id"))
    found = clustering.silhouettes(assigned, ["frequency", "rule"], stages.SEGMENTS.silhouette_sample)
    rows = [(name, score.score) for name, score in found.items()]
    scores = spark.createDataFrame(rows, "labels string, silhouette double")
    return scores.crossJoin(assigned.agg(F.count(F.lit(1)).alias("n_customers")))


@query("segment_grid")
def segment_grid(spark, sf_dir):
    return stages.segment_result(spark, sf_dir).candidates


@query("segment_customers")
def segment_customers(spark, sf_dir):
    return stages.segment_result(spark, sf_dir).segments


@query("segment_model_report")
def segment_model_report(spark, sf_dir):
    return sinks.as_json(stages.segment_result(spark, sf_dir).report)


@query("segmentation_report")
def segmentation_report(spark, sf_dir):
    result = stages.segment_result(spark, sf_dir)
    features = stages.features(spark, sf_dir)
    data = segmentation.profile_joins(
        result.segments,
        features,
        stages.labels(spark, sf_dir),
        stages.baseline_scores(features),
    )
    return sinks.as_json(segmentation.segmentation_report(result, stages.materialise(data)))


def _forest(spark, sf_dir):
    """The fitted forest, the names of its features and its contributions to the test rows."""
    model = stages.churn_model(spark, sf_dir, "random_forest")
    train, _, test = stages.three_splits(spark, sf_dir)
    columns = churn.churn_columns(train, stages.COHORTS)
    return model, modelling.vector_names(columns, model), explain.tree_shap(model, test)


@query("tree_shap")
def tree_shap(spark, sf_dir):
    """Every contribution of the forest: one row per customer and feature."""
    _, names, shap = _forest(spark, sf_dir)
    return explain.long_contributions(shap, names)


@query(
    "tree_shap_adds_up",
    BLOCKS.sql(
        f"SELECT customer_id, TRUE AS adds_up FROM p_panel WHERE cohort_date = {TEST_COHORT}",
        "p_panel",
    ),
)
def tree_shap_adds_up(spark, sf_dir):
    """Whether base plus contributions is the forest's probability, for each customer."""
    model, _, shap = _forest(spark, sf_dir)
    base = sum(explain.base_value(group) for group in explain.tree_groups(modelling.fitted_model(model)))
    test = stages.split(spark, sf_dir, stages.COHORTS.test_cohorts)
    total = F.aggregate("shap", F.lit(base), lambda s, x: s + x)
    return (
        shap.withColumn("total", total)
        .join(churn.score(model, test, stages.COHORTS, "p"), ["customer_id", "cohort_date"])
        .select("customer_id", (F.abs(F.col("total") - F.col("p")) < 1e-9).alias("adds_up"))
    )


@query("calibrate_sigmoid")
def calibrate_sigmoid(spark, sf_dir):
    """The chosen model's test scores calibrated by a fitted sigmoid."""
    scores = stages.churn_result(spark, sf_dir).scores.drop(churn.CALIBRATED)
    apply = churn.calibrator(scores.filter("split = 'validation'"), "sigmoid")
    return apply(scores.filter("split = 'test'")).select("customer_id", churn.RAW, churn.CALIBRATED)


@query("explain_report")
def explain_report(spark, sf_dir):
    return sinks.as_json(
        explain.explain_report(
            stages.explanation(spark, sf_dir), stages.churn_result(spark, sf_dir).chosen_model
        )
    )
