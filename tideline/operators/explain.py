"""Attribution of churn scores to features, per customer, segment and overall."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.functions.scalars import rounded
from tideline.operators.boosting import BoostModel
from tideline.operators.boosting import Tree as NewtonTree
from tideline.operators.modelling import FeatureColumns, fitted_model, vector_names
from tideline.params import ExplainParams
from tideline.session import materialise, new_path

SHAP = "shap"
INTERPRETATION_NOTE = (
    "Contributions describe what moves the model's score; they are associations, not causes."
)
ROWS_PER_BLOCK = 4096
#: Nodes of the trees that are sent to the tasks at a time (40 MB), or one tree if it has more.
#: Larger ensembles take several passes over the rows.
GROUP_NODES = 1_000_000


@dataclass(frozen=True)
class Tree:
    """A fitted tree in flat arrays by node; the root is node 0.

    ``left`` and ``right`` are -1 at a leaf. ``feature`` is what a node splits on. ``above``,
    ``upto`` and ``share`` belong to the edge into a node: the interval of the parent's feature
    that leads there and the share of the parent's training rows.
    """

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    above: np.ndarray
    upto: np.ndarray
    share: np.ndarray
    value: np.ndarray


def _split_interval(split) -> tuple[tuple[float, float], tuple[float, float]]:
    """The intervals (above, up to] of the left and the right child."""
    limits = list(split["leftCategoriesOrThreshold"])
    if split["numCategories"] < 0:
        return (-np.inf, limits[0]), (limits[0], np.inf)
    # One-hot entries are the only categories here: 0 or 1.
    sides = ((-np.inf, 0.5), (0.5, np.inf))
    return sides if limits == [0.0] else sides[::-1]


def _tree(nodes: dict, value_of, cover_of) -> Tree:
    size = max(nodes) + 1
    left, right, feature = (np.full(size, -1, dtype=np.int32) for _ in range(3))
    above, upto = np.full(size, -np.inf), np.full(size, np.inf)
    share, value = np.ones(size), np.zeros(size)
    for number, node in nodes.items():
        if node["leftChild"] < 0:
            value[number] = value_of(node)
            continue
        left[number], right[number] = node["leftChild"], node["rightChild"]
        feature[number] = node["split"]["featureIndex"]
        for child, (low, high) in zip((left[number], right[number]), _split_interval(node["split"])):
            above[child], upto[child] = low, high
            share[child] = cover_of(nodes[child]) / cover_of(node)
    return Tree(left, right, feature, above, upto, share, value)


def _groups(sizes: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last tree of groups of neighbours with at most ``GROUP_NODES`` nodes."""
    out: list[tuple[int, int]] = []
    room = 0
    for tree, nodes in sizes:
        if out and nodes <= room:
            out[-1] = (out[-1][0], tree)
            room -= nodes
        else:
            out.append((tree, tree))
            room = GROUP_NODES - nodes
    return out


def tree_groups(model) -> Iterator[list[Tree]]:
    """The trees of a fitted forest or boosted ensemble, read back from its saved form.

    Forest leaves hold the positive share, so contributions add up to the
    probability; boosted leaves add up to the margin. The driver holds one group at a time.
    """
    if isinstance(model, BoostModel):
        ensemble = model.fitted
        for first, last in _groups([(i, len(t.value)) for i, t in enumerate(ensemble.trees)]):
            yield [_newton_tree(tree, ensemble.cuts) for tree in ensemble.trees[first : last + 1]]
        return
    spark = SparkSession.active()
    path = new_path(spark, "trees")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    sizes = sorted(tuple(r) for r in data.groupBy("treeID").count().collect())
    for first, last in _groups(sizes):
        trees: dict[int, dict] = {}
        for row in data.filter(F.col("treeID").between(first, last)).collect():
            trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
        yield _flat(model, trees, len(sizes))


def _newton_tree(tree: NewtonTree, cuts: Sequence[np.ndarray]) -> Tree:
    """A boosted tree with the values that its bins stand for."""
    feature, cut, left, value = tree.arrays()
    split = feature >= 0
    above, upto = np.full(len(value), -np.inf), np.full(len(value), np.inf)
    for node in np.flatnonzero(split):
        # Bin b holds values above cut b - 1 up to cut b.
        limit = float(cuts[feature[node]][cut[node]])
        upto[left[node]], above[left[node] + 1] = limit, limit
    down = np.where(split, left, -1)
    leaf_value = np.where(split, 0.0, value)
    return Tree(down, np.where(split, left + 1, -1), feature, above, upto, np.array(tree.share), leaf_value)


def read_trees(model) -> list[Tree]:
    """All trees at once."""
    return [tree for group in tree_groups(model) for tree in group]


def _flat(model, trees: dict[int, dict], number_of_trees: int) -> list[Tree]:
    weights = list(model.treeWeights)
    forest = type(model).__name__.startswith("RandomForest")
    found = []
    for number in sorted(trees):
        if forest:
            def value_of(node):
                stats = node["impurityStats"]
                return stats[1] / sum(stats) / number_of_trees

            def cover_of(node):
                return sum(node["impurityStats"])
        else:
            def value_of(node, weight=weights[number]):
                return node["prediction"] * weight

            def cover_of(node):
                return node["impurityStats"][0]
        found.append(_tree(trees[number], value_of, cover_of))
    return found


def _depth(tree: Tree, node: int = 0) -> int:
    if tree.left[node] < 0:
        return 0
    return 1 + max(_depth(tree, tree.left[node]), _depth(tree, tree.right[node]))


def tree_contributions(tree: Tree, rows: np.ndarray, result: np.ndarray) -> None:
    """Add the Shapley values of one tree for a block of rows to ``result``.

    The Shapley weight of a coalition of s out of d - 1 others is the integral of
    t^s (1 - t)^(d-1-s) over [0, 1]. Summed over coalitions, a leaf's part for a feature is the
    integral of the product, over the other features of its path, of share (1 - t) + inside t:
    a polynomial that Gauss-Legendre nodes integrate exactly. The product is carried down the
    tree and the leaves' values times it are summed on the way up, so that a split costs the
    same whatever the number of leaves below it. A feature that is split on again replaces its
    factor; leaves below count for the last split only, which the subtraction sees to.
    """
    x, w = np.polynomial.legendre.leggauss(max(1, (_depth(tree) + 1) // 2))
    t, w = (x + 1.0) / 2.0, w / 2.0
    # By feature of the path: (inside - share, share, inside, factor).
    path: dict[int, tuple] = {}

    def below(node: int, product: np.ndarray) -> np.ndarray:
        if tree.left[node] < 0:
            return tree.value[node] * product
        feature = int(tree.feature[node])
        values, old = rows[:, feature], path.get(feature)
        total = 0.0
        for child in (int(tree.left[node]), int(tree.right[node])):
            inside = (values > tree.above[child]) & (values <= tree.upto[child])
            share = tree.share[child]
            if old is not None:
                inside, share = inside & old[2], share * old[1]
            factor = np.where(inside[:, None], share * (1.0 - t) + t, share * (1.0 - t))
            path[feature] = (inside - share, share, inside, factor)
            here = below(child, product * (factor if old is None else factor / old[3]))
            result[:, feature] += (inside - share) * ((here / factor) @ w)
            if old is not None:
                result[:, feature] -= old[0] * ((here / old[3]) @ w)
            total = total + here
        if old is None:
            del path[feature]
        else:
            path[feature] = old
        return total

    below(0, np.ones((len(rows), len(t))))


def forest_contributions(trees: Sequence[Tree], rows: np.ndarray) -> np.ndarray:
    result = np.zeros_like(rows)
    for tree in trees:
        if tree.left[0] >= 0:
            tree_contributions(tree, rows, result)
    return result


def base_value(trees: Iterable[Tree]) -> float:
    """The mean score of the training rows."""

    def mean(tree: Tree, node: int) -> float:
        if tree.left[node] < 0:
            return float(tree.value[node])
        return sum(tree.share[c] * mean(tree, c) for c in (tree.left[node], tree.right[node]))

    return float(sum(mean(tree, 0) for tree in trees))


def _vectors(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    before = PipelineModel(list(model.stages[: list(model.stages).index(fitted_model(model))]))
    return before.transform(df).select(*keep, "features")


def tree_shap(
    model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("customer_id", "cohort_date")
) -> DataFrame:
    """Contributions of every vector entry, as an array column, row by row without a shuffle.

    Contributions of trees add up, so an ensemble of any size is taken group by group; what the
    groups before gave is written between two passes.
    """
    vectors = _vectors(model, df, keep)
    predictor = fitted_model(model)
    if not isinstance(predictor, BoostModel) and not hasattr(predictor, "treeWeights"):
        return _linear_shap(predictor, vectors, keep)
    x = vector_to_array("features")
    done = vectors.select(*keep, x.alias("x"), F.array_repeat(F.lit(0.0), F.size(x)).alias(SHAP))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.schema)
    shared = None
    for group in tree_groups(predictor):
        if shared is not None:
            done = materialise(done)
            shared.destroy()
        shared = df.sparkSession.sparkContext.broadcast(group)
        done = done.mapInPandas(_attributed(shared), fields)
    return done.drop("x")


def _attributed(shared):
    """Adds the contributions of the broadcast trees to ``shap``."""

    def attribute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ROWS_PER_BLOCK):
                part = batch.iloc[start : start + ROWS_PER_BLOCK]
                rows = np.stack(part["x"].to_numpy())
                shap = np.stack(part[SHAP].to_numpy()) + forest_contributions(shared.value, rows)
                yield part.assign(**{SHAP: list(shap)})

    return attribute


def _linear_shap(predictor, vectors: DataFrame, keep: Sequence[str]) -> DataFrame:
    """A linear model: coefficient times distance from the mean."""
    means = vectors.select(Summarizer.mean(F.col("features"))).head()[0].toArray()
    weight = F.array(*[F.lit(float(c)) for c in predictor.coefficients.toArray()])
    centre = F.array(*[F.lit(float(m)) for m in means])
    distance = F.zip_with(vector_to_array("features"), centre, lambda x, m: x - m)
    return vectors.select(
        *keep, F.zip_with(weight, distance, lambda w, d: w * d).alias(SHAP)
    )


def _named(names: Sequence[str]) -> Column:
    return F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"), F.col(SHAP).alias("shap_value")
    )


def customer_top_factors(
    shap: DataFrame, names: Sequence[str], params: ExplainParams = ExplainParams()
) -> DataFrame:
    """The strongest features of each customer, sorted inside the row: no shuffle."""
    keyed = F.transform(
        _named(names),
        lambda e: F.struct(
            (-F.abs(e["shap_value"])).alias("order"),
            e["feature"].alias("feature"),
            e["shap_value"].alias("shap_value"),
        ),
    )
    top = F.slice(F.array_sort(keyed), 1, params.top_factors)
    exploded = shap.select("customer_id", F.posexplode(top).alias("_place", "_factor"))
    value = F.col("_factor.shap_value")
    return exploded.select(
        "customer_id",
        (F.col("_place") + 1).alias("rank"),
        F.col("_factor.feature").alias("feature"),
        value.alias("shap_value"),
        F.abs(value).alias("abs_shap"),
        F.when(value > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
    )


def long_contributions(
    shap: DataFrame, names: Sequence[str], keep: Sequence[str] = ("customer_id", "cohort_date")
) -> DataFrame:
    """Every contribution: one row per customer and feature."""
    return _long(shap, names, keep)


def _long(shap: DataFrame, names: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return shap.select(*keep, F.explode(_named(names)).alias("_e")).select(*keep, "_e.*")


def global_importance(shap: DataFrame, names: Sequence[str]) -> DataFrame:
    means = _long(shap, names, []).groupBy("feature").agg(
        F.avg(F.abs("shap_value")).alias("mean_abs_shap")
    )
    # One row per feature.
    place = F.row_number().over(W.orderBy(F.col("mean_abs_shap").desc(), "feature"))
    return means.withColumn("rank", place)


def segment_factors(
    shap: DataFrame,
    names: Sequence[str],
    segments: DataFrame,
    params: ExplainParams = ExplainParams(),
) -> DataFrame:
    """Per segment the features with the largest absolute mean contribution.

    ``mean_abs_shap`` is given beside it: contributions that cancel out count there.
    """
    joined = shap.join(segments.select("customer_id", "segment_name"), "customer_id")
    means = (
        _long(joined, names, ["segment_name"])
        .groupBy("segment_name", "feature")
        .agg(
            F.abs(F.avg("shap_value")).alias("abs_mean_shap"),
            F.avg(F.abs("shap_value")).alias("mean_abs_shap"),
        )
    )
    along = W.partitionBy("segment_name").orderBy(F.col("abs_mean_shap").desc(), "feature")
    return (
        means.withColumn("rank", F.row_number().over(along))
        .filter(F.col("rank") <= params.top_factors)
        .select("segment_name", "rank", "feature", "abs_mean_shap", "mean_abs_shap")
    )


@dataclass(frozen=True)
class Explanation:
    shap: DataFrame
    names: list[str]
    importance: DataFrame
    factors: DataFrame
    segment_factors: DataFrame


def explain(
    model: PipelineModel,
    columns: FeatureColumns,
    test: DataFrame,
    segments: DataFrame,
    params: ExplainParams = ExplainParams(),
) -> Explanation:
    names = vector_names(columns, model)
    shap = tree_shap(model, test)
    return Explanation(
        shap,
        names,
        global_importance(shap, names),
        customer_top_factors(shap, names, params),
        segment_factors(shap, names, segments, params),
    )


def explain_report(found: Explanation, model_name: str) -> DataFrame:
    """One row: counts, the twenty strongest features and the segments' factors."""
    top = found.importance.orderBy("rank").limit(20).withColumn(
        "mean_abs_shap", rounded(F.col("mean_abs_shap"))
    )
    parts = found.segment_factors.withColumns(
        {c: rounded(F.col(c)) for c in ("abs_mean_shap", "mean_abs_shap")}
    )

    def rows_of(df: DataFrame, first: Sequence[str]) -> Column:
        ordered = [*first, *[c for c in df.columns if c not in first]]
        return df.agg(F.array_sort(F.collect_list(F.struct(*ordered)))).scalar()

    return found.shap.agg(F.count(F.lit(1)).alias("n_customers_explained")).select(
        F.lit(model_name).alias("explained_model"),
        "n_customers_explained",
        F.lit(len(found.names)).alias("n_features"),
        rows_of(top, ["rank"]).alias("top_global_features"),
        rows_of(parts, ["segment_name", "rank"]).alias("segment_risk_factors"),
        F.lit(INTERPRETATION_NOTE).alias("interpretation_note"),
    )
