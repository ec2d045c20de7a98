"""Random forests whose trees are grown whole, many at a time.

MLlib adds up one table of statistics per node over all partitions, so deep trees are a chain of
jobs whose shuffles grow with the nodes. Here rows that fit in one block (``BLOCK_ROWS``) are
binned once, and tasks of ``TREES_PER_TASK`` trees each grow their trees level by level on the
block, with no exchange between them. More rows are left to MLlib. The trees are those of
MLlib's method: rows drawn with Poisson(1) counts, at most ``maxBins`` bins whose borders lie
midway between values, a drawn subset of the features at each node, Gini or variance gain, and
siblings with equal predictions merged. They are written in MLlib's saved form and read back as its
model, so scoring, importance and storage are MLlib's; the draws differ from those of its own fit.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import materialise, new_path

#: The most rows of a block, and the trees of a task.
BLOCK_ROWS = 524_288
TREES_PER_TASK = 4
#: Impurity below which MLlib takes a node as pure.
PURE = 2.0**-52

_BLOCK = "bins binary, borders array<array<double>>, y binary, w binary"
_NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, "
    "impurityStats array<double>, rawCount bigint, gain double, leftChild int, rightChild int, "
    "split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


@dataclass(frozen=True)
class Growth:
    """How trees are grown; ``drawn`` features are looked at in each node."""

    classes: bool
    depth: int
    min_rows: int
    min_gain: float
    drawn: int
    seed: int


@dataclass
class Grown:
    """One tree: an entry per node, children behind their parent; leaves have ``left`` -1."""

    n: np.ndarray
    stats: np.ndarray
    gain: np.ndarray
    left: np.ndarray
    feature: np.ndarray
    cut: np.ndarray


def borders(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """Borders between at most ``bins`` bins of about equal weight, midway between values."""
    found, place = np.unique(values, return_inverse=True)
    if len(found) <= bins:
        return (found[:-1] + found[1:]) / 2
    upto = np.bincount(place, weights).cumsum()
    stride, middle = upto[-1] / bins, upto[:-1] + upto[1:]
    at, out = 0, []
    for target in stride * np.arange(1, bins):
        at = max(at, int(np.searchsorted(middle, 2 * target, side="right")))
        if at >= len(middle):
            break
        out.append((found[at] + found[at + 1]) / 2)
        at += 1
    return np.array(out)


def _small(bins: int) -> str:
    """The narrowest whole numbers for that many bins."""
    return "u1" if bins <= 256 else "<u4"


def _block(bins: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task as one row of bytes; ``bins`` has one line per feature.

    Rows are put in order, so that draws do not depend on how the table was written.
    """
    x, y, w = [], [], []
    for batch in batches:
        if batch.num_rows:
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x.append(values.reshape(batch.num_rows, -1))
            y.append(batch.column("y").to_numpy(zero_copy_only=False).astype("<f8"))
            w.append(batch.column("w").to_numpy(zero_copy_only=False).astype("<f8"))
    if not x:
        return
    label, weight = np.concatenate(y), np.concatenate(w)
    cuts, binned = [], np.empty((x[0].shape[1], len(label)), dtype=_small(bins))
    for i, line in enumerate(binned):
        values = np.concatenate([part[:, i] for part in x])
        cuts.append(borders(values, weight, bins))
        line[:] = np.searchsorted(cuts[-1], values)
    del x
    order = np.lexsort([*binned, weight, label])
    parts = [
        pa.array([binned[:, order].tobytes()], pa.binary()),
        pa.array([[c.tolist() for c in cuts]], pa.list_(pa.list_(pa.float64()))),
        pa.array([label[order].tobytes()], pa.binary()),
        pa.array([weight[order].tobytes()], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(parts, ["bins", "borders", "y", "w"])


def _sides(slot: np.ndarray, parts: list[np.ndarray], nodes: int, bins: int) -> list[np.ndarray]:
    """Sums of each part per (node, bin) up to a border; the last column is the whole node."""
    return [np.bincount(slot, p, nodes * bins).reshape(nodes, bins).cumsum(axis=1) for p in parts]


def _best_splits(
    at: np.ndarray, bins: np.ndarray, widths: np.ndarray, chosen: np.ndarray | None,
    parts: list[np.ndarray], nodes: int, min_rows: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each open node the best gain in squares (row weights times values), feature and bin."""
    best = np.full(nodes, -np.inf)
    feature, cut = np.zeros(nodes, dtype=np.int64), np.zeros(nodes, dtype=np.int64)
    each, rows = np.arange(nodes), np.arange(len(at))
    for i in range(len(bins) if chosen is None else chosen.shape[1]):
        mine = np.full(nodes, i) if chosen is None else chosen[:, i]
        width = int(widths[i] if chosen is None else widths.max())
        if width < 2:
            continue
        own = bins[i] if chosen is None else bins[mine[at], rows]
        sums = _sides(at * width + own, parts, nodes, width)
        n, s, w = sums[0], sums[1], sums[-1] if len(sums) == 3 else sums[0]
        left, right = w[:, :-1], w[:, -1:] - w[:, :-1]
        allowed = (n[:, :-1] >= min_rows) & (n[:, -1:] - n[:, :-1] >= min_rows)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = s[:, :-1] ** 2 / left + (s[:, -1:] - s[:, :-1]) ** 2 / right
        gain = np.where(allowed & (left > 0) & (right > 0), gain, -np.inf)
        top = gain.argmax(axis=1)
        found = gain[each, top] - s[:, -1] ** 2 / w[:, -1]
        better = found > best
        best[better], feature[better], cut[better] = found[better], mine[better], top[better]
    return best, feature, cut


def _impurity(stats: np.ndarray, classes: bool) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            whole = stats.sum(axis=1)
            found = 1 - (stats**2).sum(axis=1) / whole**2
        else:
            whole = stats[:, 0]
            found = stats[:, 2] / whole - (stats[:, 1] / whole) ** 2
    return np.where(whole > 0, found, 0.0)


def _predictions(stats: np.ndarray, classes: bool) -> np.ndarray:
    if classes:
        return stats.argmax(axis=1).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(stats[:, 0] > 0, stats[:, 1] / stats[:, 0], 0.0)


def grow(bins: np.ndarray, widths: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, how: Growth) -> Grown:
    """One tree on rows drawn with Poisson counts, all open nodes of a level at once."""
    draw = np.random.default_rng([how.seed % 2**64, tree])
    counts = draw.poisson(1.0, len(y))
    if not counts.any():
        counts[:] = 1
    rows = np.flatnonzero(counts)
    bins, y, n = np.ascontiguousarray(bins[:, rows]), y[rows], counts[rows].astype(float)
    w = n * w[rows]
    plain = bool((w == n).all())
    kinds = [w * (1 - y), w * y] if how.classes else [w, w * y, w * y * y]
    at, nodes, made = np.zeros(len(rows), dtype=np.int64), 1, 0
    out: list[Grown] = []
    for depth in range(how.depth + 1):
        count = np.bincount(at, n, nodes)
        stats = np.stack([np.bincount(at, k, nodes) for k in kinds], axis=1)
        level = Grown(
            count, stats, np.full(nodes, -1.0), np.full(nodes, -1), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
        )
        out.append(level)
        made += nodes
        opened = (count >= 2 * how.min_rows) & (_impurity(stats, how.classes) >= PURE)
        if depth == how.depth or not opened.any():
            break
        # Rows of closed nodes leave.
        place, stay = opened.cumsum() - 1, opened[at]
        if not stay.all():
            bins, y, n, w = bins[:, stay], y[stay], n[stay], w[stay]
            kinds = [k[stay] for k in kinds]
            at = at[stay]
        at, still = place[at], np.flatnonzero(opened)
        chosen = None
        if how.drawn < len(bins):
            chosen = draw.random((len(still), len(bins))).argpartition(how.drawn - 1, axis=1)[:, : how.drawn]
        parts = [n, w * y] if plain else [n, w * y, w]
        gain, feature, cut = _best_splits(at, bins, widths, chosen, parts, len(still), how.min_rows)
        whole = stats[still].sum(axis=1) if how.classes else stats[still, 0]
        # In two classes the Gini impurity is twice the variance of the label.
        gain = gain / whole * (2 if how.classes else 1)
        paid = (gain > 0) & (gain >= how.min_gain)
        if not paid.any():
            break
        split = still[paid]
        level.gain[split], level.feature[split], level.cut[split] = gain[paid], feature[paid], cut[paid]
        level.left[split] = made + 2 * np.arange(len(split))
        stay = paid[at]
        if not stay.all():
            bins, y, n, w = bins[:, stay], y[stay], n[stay], w[stay]
            kinds = [k[stay] for k in kinds]
            at = at[stay]
        right = bins[feature[at], np.arange(len(at))] > cut[at]
        at = 2 * (paid.cumsum() - 1)[at] + right
        nodes = 2 * len(split)
    whole = [np.concatenate(p) for p in zip(*[(g.n, g.stats, g.gain, g.left, g.feature, g.cut) for g in out])]
    return _merged(Grown(*whole), how.classes)


def _merged(tree: Grown, classes: bool) -> Grown:
    """Siblings that are leaves with equal predictions become one leaf, from the bottom up."""
    said, left = _predictions(tree.stats, classes), tree.left.copy()
    for node in np.flatnonzero(left >= 0)[::-1]:
        a = left[node]
        if left[a] < 0 and left[a + 1] < 0 and said[a] == said[a + 1]:
            left[node] = -1
    used = np.zeros(len(left), dtype=bool)
    used[0] = True
    for node in np.flatnonzero(left >= 0):
        if used[node]:
            used[left[node] : left[node] + 2] = True
    inner = left >= 0
    place = used.cumsum() - 1
    parts = (
        tree.n, tree.stats, np.where(inner, tree.gain, -1.0), np.where(inner, place[left], -1),
        np.where(inner, tree.feature, -1), tree.cut,
    )
    return Grown(*[p[used] for p in parts])


def _saved(tree: Grown, number: int, cuts: list[np.ndarray], classes: bool) -> pa.RecordBatch:
    """The nodes of a tree as MLlib stores them."""
    size, inner = len(tree.left), tree.left >= 0
    limits = [[float(cuts[f][c])] if f >= 0 else [] for f, c in zip(tree.feature, tree.cut)]
    split = pa.StructArray.from_arrays(
        [pa.array(tree.feature, pa.int32()), pa.array(limits, pa.list_(pa.float64())), pa.array(np.full(size, -1), pa.int32())],
        ["featureIndex", "leftCategoriesOrThreshold", "numCategories"],
    )
    fields = {
        "id": pa.array(np.arange(size), pa.int32()),
        "prediction": pa.array(_predictions(tree.stats, classes)),
        "impurity": pa.array(_impurity(tree.stats, classes)),
        "impurityStats": pa.array(tree.stats.tolist(), pa.list_(pa.float64())),
        "rawCount": pa.array(tree.n.astype(np.int64)),
        "gain": pa.array(tree.gain),
        "leftChild": pa.array(tree.left, pa.int32()),
        "rightChild": pa.array(np.where(inner, tree.left + 1, -1), pa.int32()),
        "split": split,
    }
    nodes = pa.StructArray.from_arrays(list(fields.values()), list(fields))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, number), pa.int32()), nodes], ["treeID", "nodeData"])


def _trees(trees: int, how: Growth, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            y, w = (np.frombuffer(row[name], dtype="<f8") for name in ("y", "w"))
            cuts = [np.array(c, dtype=float) for c in row["borders"]]
            widths = np.array([len(c) + 1 for c in cuts])
            bins = np.frombuffer(row["bins"], dtype=kind).reshape(-1, len(y))
            first = row["id"] * TREES_PER_TASK
            for number in range(first, min(first + TREES_PER_TASK, trees)):
                yield _saved(grow(bins, widths, y, w, number, how), number, cuts, how.classes)


def features_drawn(strategy: str, width: int, trees: int, classes: bool) -> int | None:
    """Features a node looks at, as MLlib counts them; None for strategies it has to read."""
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    return {
        "all": width,
        "sqrt": math.ceil(math.sqrt(width)),
        "log2": max(1, math.ceil(math.log2(width))),
        "onethird": math.ceil(width / 3),
    }.get(strategy)


class Forest(Estimator):
    """``inner``, a forest estimator of MLlib, fitted by ``grow`` where its rows fit in one block.

    Anything else (more rows, labels other than both of 0 and 1 for classes, values that are not
    numbers) is fitted, or refused, by MLlib itself.
    """

    def __init__(self, inner: RandomForestClassifier | RandomForestRegressor):
        super().__init__()
        self.inner = inner

    def copy(self, extra=None):
        return Forest(self.inner.copy(extra))

    def _fit(self, dataset: DataFrame):
        inner, classes = self.inner, isinstance(self.inner, RandomForestClassifier)
        weight = inner.getWeightCol() if inner.isDefined("weightCol") and inner.getWeightCol() else None
        rows = dataset.select(
            vector_to_array(inner.getFeaturesCol()).alias("x"),
            F.col(inner.getLabelCol()).cast("double").alias("y"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        )
        odd = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        seen = rows.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(odd("y") | odd("w") | (F.col("w") < 0)).alias("odd"),
            F.count_if(F.col("x").isNull() | F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))).alias("odd_x"),
            F.count_if(~F.col("y").isin(0.0, 1.0)).alias("other"),
            F.min("y").alias("low"),
            F.max("y").alias("high"),
            F.sum("w").alias("w"),
            F.max(F.size("x")).alias("width"),
        ).first()
        fits = 0 < seen["n"] <= BLOCK_ROWS and not seen["odd"] and not seen["odd_x"] and seen["w"] > 0
        if fits and classes:
            fits = not seen["other"] and seen["low"] < seen["high"]
        trees, plain = inner.getNumTrees(), inner.getBootstrap() and inner.getSubsamplingRate() == 1.0
        drawn = features_drawn(inner.getFeatureSubsetStrategy(), seen["width"] or 1, trees, classes)
        plain = plain and inner.getMinWeightFractionPerNode() == 0.0
        impurity = inner.getImpurity() == ("gini" if classes else "variance")
        if not (fits and plain and impurity and drawn):
            return inner.fit(dataset)
        how = Growth(
            classes, inner.getMaxDepth(), inner.getMinInstancesPerNode(), inner.getMinInfoGain(), drawn, inner.getSeed()
        )
        spark = dataset.sparkSession
        block = materialise(rows.coalesce(1).mapInArrow(partial(_block, inner.getMaxBins()), _BLOCK))
        tasks = -(-trees // TREES_PER_TASK)
        shared = spark.range(0, tasks, 1, tasks).crossJoin(F.broadcast(block))
        path = new_path(spark, "forest")
        shared.mapInArrow(partial(_trees, trees, how, _small(inner.getMaxBins())), _NODES).write.parquet(f"{path}/data")
        return _loaded(spark, inner, path, trees, seen["width"], classes)


def _metadata(spark: SparkSession, estimator, model: str, **more) -> str:
    """What MLlib stores beside a fitted model, from the estimator's own stored form."""
    path = new_path(spark, "estimator")
    estimator.write().overwrite().save(path)
    found = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    found["class"] = f"{found['class'].rsplit('.', 1)[0]}.{model}"
    return json.dumps(found | more)


def _loaded(spark: SparkSession, inner, path: str, trees: int, width: int, classes: bool):
    """The model whose nodes lie in ``path``/data."""
    sizes = {"numFeatures": width} | ({"numClasses": 2} if classes else {})
    kind = "Classification" if classes else "Regression"
    forest = _metadata(spark, inner, f"RandomForest{kind}Model", numTrees=trees, **sizes)
    single = DecisionTreeClassifier() if classes else DecisionTreeRegressor()
    one = _metadata(spark, single, f"DecisionTree{kind}Model", **sizes)
    spark.createDataFrame([(forest,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    each = spark.range(trees).select(
        F.col("id").cast("int").alias("_1"), F.lit(one).alias("_2"), F.lit(1.0).alias("_3")
    )
    each.write.parquet(f"{path}/treesMetadata")
    return (RandomForestClassificationModel if classes else RandomForestRegressionModel).load(path)
