"""Newton boosting of regression trees on the Tweedie deviance, the logistic or the squared loss.

With a log link and variance power p between 1 and 2, a row of value y and margin f has the
Tweedie loss

    exp((2 - p) f) / (2 - p) - y exp((1 - p) f) / (1 - p)

and the logistic loss log(1 + exp(f)) - y f with y of 0 or 1. Rows may have weights. Each round fits a tree to its gradients g and curvatures h: a node's best split has the largest
sum of G * G / H over its two sides, and a leaf moves the margin by -rate * G / H.

How it runs: features are binned once, by quantiles, and written as blocks of bytes beside the
target and the margin. A level of a tree is one job: each task adds up g, h and rows per (node,
feature, bin) over its blocks, and the sums are added in a tree of tasks, as DataFrame aggregates
would have to take the arrays apart into rows. The driver gets one such table per level, whose
size is given by the tree's width, the features and the bins, never by the rows. Leaf values come
from the sums of the last split, so a round has as many jobs as levels. The trees since the last
write travel with the job; every ``REFRESH`` rounds the margins are written with the blocks, which
cuts the lineage. Rows that fit in one block have one task at every level: then the ``REFRESH``
rounds between two writes are one job, which does the same sums without the latency of many.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tideline.session import materialise

#: Bins of a feature, the most rows of a block, and those of one of several blocks.
BINS = 128
BLOCK_ROWS = 131_072
SPLIT_ROWS = 32_768
#: Rounds between two writes of the margins.
REFRESH = 25
MAX_MARGIN = 50.0


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 400
    rate: float = 0.05
    depth: int = 5
    min_rows: int = 20
    loss: str = "tweedie"
    row_share: float = 0.8
    feature_share: float = 0.8
    variance_power: float = 1.5
    seed: int = 42


@dataclass
class Tree:
    """Nodes in the order they were made: children of ``node`` are ``left`` and ``left + 1``."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    # Share of the drawn training rows of the parent; 1 at the root.
    share: list[float] = field(default_factory=lambda: [1.0])

    def split(
        self, node: int, feature: int, cut: int, gain: float, values: list[float], rows: list[float]
    ) -> tuple[int, int]:
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, len(self.value), gain
        self.share += [n / sum(rows) for n in rows]
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(value)
            self.gain.append(0.0)
        return self.left[node], self.left[node] + 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left), np.array(self.value)


def leaves(tree: Tree, bins: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row of a block (``bins`` has one line per feature)."""
    feature, cut, left, _ = tree.arrays()
    node = np.zeros(bins.shape[1], dtype=np.int64)
    rows = np.arange(bins.shape[1])
    for _ in range(depth):
        chosen = feature[node]
        right = bins[np.maximum(chosen, 0), rows] > cut[node]
        node = np.where(chosen >= 0, left[node] + right, node)
    return node


def loss_parts(params: BoostParams, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and curvature of each row."""
    if params.loss == "squared":
        return (margin - y) ** 2 / 2, margin - y, np.ones(len(y))
    f, power = np.clip(margin, -MAX_MARGIN, MAX_MARGIN), params.variance_power
    if params.loss == "logistic":
        p = 1 / (1 + np.exp(-f))
        return np.logaddexp(0, f) - y * f, p - y, np.maximum(p * (1 - p), 1e-12)
    down, up = y * np.exp((1 - power) * f), np.exp((2 - power) * f)
    return up / (2 - power) - down / (1 - power), up - down, (2 - power) * up - (1 - power) * down


def cut_points(df: DataFrame, column: str, width: int, bins: int = BINS) -> list[np.ndarray]:
    """For each entry of an array column the values between its bins, from one aggregate.

    ``percentile_approx`` merges bounded summaries, so the data is read once and not sorted.
    """
    shares = [(i + 1) / bins for i in range(bins - 1)]
    found = df.agg(*[F.percentile_approx(F.col(column)[i], shares, 10_000).alias(f"q{i}") for i in range(width)]).first()
    return [np.unique(np.array(found[f"q{i}"] or [], dtype=float)) for i in range(width)]


def starting_margin(params: BoostParams, mean: float) -> float:
    """The margin whose prediction is the mean."""
    if params.loss == "squared":
        return mean
    if params.loss == "logistic":
        p = min(max(mean, 1e-12), 1 - 1e-12)
        return math.log(p / (1 - p))
    if params.loss == "tweedie":
        return math.log(max(mean, 1e-12))
    raise ValueError(f"unknown loss: {params.loss}")


_BLOCK = "bins binary, y binary, w binary, margin binary, n long"


def _blocks(
    cuts: list[np.ndarray], base: float, size: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[pa.RecordBatch]:
    def block() -> pa.RecordBatch:
        margin = np.full(sum(map(len, y)), base, dtype="<f8")
        whole = [np.concatenate(bins, axis=1), np.concatenate(y), np.concatenate(w), margin]
        arrays = [*[pa.array([p.tobytes()], pa.binary()) for p in whole], pa.array([len(margin)])]
        return pa.RecordBatch.from_arrays(arrays, ["bins", "y", "w", "margin", "n"])

    bins: list[np.ndarray] = []
    y: list[np.ndarray] = []
    w: list[np.ndarray] = []
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            if y and sum(map(len, y)) + part.num_rows > size:
                yield block()
                bins, y, w = [], [], []
            values = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            bins.append(np.stack([np.searchsorted(c, values[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8))
            for column, out in (("y", y), ("w", w)):
                out.append(part.column(column).to_numpy(zero_copy_only=False).astype("<f8"))
    if y:
        yield block()


def _opened(row) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(row["bins"], dtype=np.uint8).reshape(-1, row["n"])
    y, w, margin = (np.frombuffer(row[name], dtype="<f8") for name in ("y", "w", "margin"))
    return row["block"], bins, y, w, margin


def _moved(margin: np.ndarray, bins: np.ndarray, trees: list[Tree], depth: int) -> np.ndarray:
    for tree in trees:
        margin = margin + np.array(tree.value)[leaves(tree, bins, depth)]
    return margin


def _refreshed(trees: list[Tree], depth: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            _, bins, _, _, margin = _opened(row)
            row["margin"] = _moved(margin, bins, trees, depth).astype("<f8").tobytes()
            yield pa.RecordBatch.from_pylist([row], batch.schema)


@dataclass(frozen=True)
class _Level:
    """What a job needs: earlier trees, the tree so far, its depth, open nodes and the features."""

    trees: list[Tree]
    tree: Tree
    depth: int
    nodes: list[int]
    features: np.ndarray
    round: int
    params: BoostParams


def _drawn(params: BoostParams, at: int, features: np.ndarray, row: tuple) -> tuple:
    """Of a block in a round: bins of the drawn rows, g, h and the chosen features, and its loss."""
    block, bins, y, w, margin = row
    cost, g, h = loss_parts(params, y, margin)
    rows = np.flatnonzero(np.random.default_rng([params.seed, at, block]).random(len(y)) < params.row_share)
    bins = bins[:, rows]
    return bins, (w * g)[rows], (w * h)[rows], bins[features], float((w * cost).sum())


def _sums(level: _Level, drawn: Iterator) -> Iterator[tuple[np.ndarray, float]]:
    """g, h and rows per (node, feature, bin) of a task's blocks, and the loss before the round."""
    out, loss = np.zeros((3, len(level.nodes), len(level.features), BINS)), 0.0
    place = np.full(len(level.tree.value), -1)
    place[level.nodes] = np.arange(len(level.nodes))
    size = len(level.nodes) * BINS
    for bins, g, h, chosen, cost in drawn:
        loss += cost
        at = place[leaves(level.tree, bins, level.depth)]
        if (at < 0).any():
            rows = np.flatnonzero(at >= 0)
            at, g, h, chosen = at[rows], g[rows], h[rows], chosen[:, rows]
        at = at * BINS
        for i, own in enumerate(chosen):
            slot = at + own
            for part, weights in enumerate((g, h, None)):
                out[part, :, i] += np.bincount(slot, weights, size).reshape(-1, BINS)
    yield out, loss


def _sums_of_blocks(level: _Level, blocks: Iterator) -> Iterator[tuple[np.ndarray, float]]:
    def drawn(block: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray, margin: np.ndarray) -> tuple:
        margin = _moved(margin, bins, level.trees, level.params.depth)
        return _drawn(level.params, level.round, level.features, (block, bins, y, w, margin))

    return _sums(level, (drawn(*row) for row in blocks))


def _added(a: tuple[np.ndarray, float], b: tuple[np.ndarray, float]) -> tuple[np.ndarray, float]:
    return a[0] + b[0], a[1] + b[1]


def _grow(level: _Level, sums: np.ndarray) -> list[int]:
    """Split the open nodes of ``level`` where that pays; returns the new nodes."""
    p, opened = level.params, []
    upto = sums.cumsum(axis=3)
    whole = upto[:, :, :, -1:]
    rest = whole - upto
    score = lambda s: s[0] ** 2 / np.maximum(s[1], 1e-12)
    gain = score(upto) + score(rest) - score(whole)
    gain[(upto[2] < p.min_rows) | (rest[2] < p.min_rows)] = 0.0
    for i, node in enumerate(level.nodes):
        best = int(gain[i].argmax())
        feature, cut = divmod(best, BINS)
        if gain[i, feature, cut] <= 1e-9:
            continue
        g, h, rows = ([float(s[part, i, feature, cut]) for s in (upto, rest)] for part in range(3))
        values = [-p.rate * x / max(y, 1e-12) for x, y in zip(g, h)]
        opened += level.tree.split(node, int(level.features[feature]), cut, float(gain[i, feature, cut]), values, rows)
    return opened


def _tree(
    at: int, chosen: np.ndarray, trees: list[Tree], params: BoostParams, summed: Callable[[_Level], tuple[np.ndarray, float]]
) -> tuple[Tree, float]:
    """The tree of round ``at`` and the loss before it, level by level."""
    tree, nodes, before = Tree(), [0], 0.0
    for depth in range(params.depth):
        level = _Level(trees, tree, depth, nodes, chosen, at, params)
        sums, loss = summed(level)
        before = before if depth else loss
        nodes = _grow(level, sums)
        if not nodes:
            break
    return tree, before


def _rounds_of_one_block(
    start: int, drawn: list[np.ndarray], params: BoostParams, blocks: Iterator
) -> Iterator[list[tuple[Tree, float]]]:
    """Rounds in the task that holds all rows."""
    out = []
    for block, bins, y, w, margin in blocks:
        for at, chosen in enumerate(drawn, start):
            part = _drawn(params, at, chosen, (block, bins, y, w, margin))
            found = _tree(at, chosen, [], params, lambda level, p=part: next(_sums(level, iter([p]))))
            margin = _moved(margin, bins, [found[0]], params.depth)
            out.append(found)
    yield out


def boost(df: DataFrame, features: str, label: str, params: BoostParams, weight: str | None = None) -> Boosted:
    """Fit to the array column ``features`` and the column ``label``; the Tweedie loss takes
    negative values as 0."""
    y = F.col(label).cast("double")
    rows = df.select(
        F.col(features).alias("x"),
        (F.greatest(y, F.lit(0.0)) if params.loss == "tweedie" else y).alias("y"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    first = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("w"),
        (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("mean"),
        F.max(F.size("x")).alias("width"),
    ).first()
    if not first["n"]:
        raise ValueError("no rows to fit")
    width, base = first["width"], starting_margin(params, first["mean"])
    cuts = cut_points(rows, "x", width)
    size = BLOCK_ROWS if first["n"] <= BLOCK_ROWS else min(BLOCK_ROWS, SPLIT_ROWS)
    tasks = max(1, -(-first["n"] // size))
    cut = rows.coalesce(tasks).mapInArrow(partial(_blocks, cuts, base, size), _BLOCK)
    table = materialise(cut.withColumn("block", F.monotonically_increasing_id()))
    draw = np.random.default_rng(params.seed)
    share = max(1, round(params.feature_share * width))
    trees: list[Tree] = []
    losses: list[float] = []
    blocks = table.count()
    for start in range(0, params.rounds, REFRESH):
        drawn = [np.sort(draw.choice(width, share, replace=False)) for _ in range(min(REFRESH, params.rounds - start))]
        opened = table.rdd.map(_opened)
        if blocks == 1:
            parts = opened.mapPartitions(partial(_rounds_of_one_block, start, drawn, params)).collect()
            found = [x for part in parts for x in part]
        else:
            opened = opened.persist(StorageLevel.MEMORY_AND_DISK)
            found = []
            for at, chosen in enumerate(drawn, start):
                summed = lambda level: opened.mapPartitions(partial(_sums_of_blocks, level)).treeReduce(_added)  # noqa: B023, E731
                found.append(_tree(at, chosen, [t for t, _ in found], params, summed))
        fresh = [t for t, _ in found]
        trees += fresh
        losses += [loss / first["w"] for _, loss in found]
        if start + REFRESH < params.rounds:
            table = materialise(table.mapInArrow(partial(_refreshed, fresh, params.depth), table.schema))
        opened.unpersist()
    limits = (-math.inf, math.inf) if params.loss == "squared" else (-MAX_MARGIN, MAX_MARGIN)
    return Boosted(base, trees, cuts, losses, params.depth, limits)


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble; ``losses`` are those of all rows before each round."""

    base: float
    trees: list[Tree]
    cuts: list[np.ndarray]
    losses: list[float]
    depth: int
    # Margins of log and logistic links are held inside; those of means are not.
    limits: tuple[float, float] = (-math.inf, math.inf)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(self.cuts)]).astype(np.uint8)
        return _moved(np.full(len(x), self.base), bins, self.trees, self.depth)

    def importances(self) -> np.ndarray:
        """Share of each feature in the gains of all splits."""
        out = np.zeros(len(self.cuts))
        for tree in self.trees:
            for feature, gain in zip(tree.feature, tree.gain):
                if feature >= 0:
                    out[feature] += gain
        return out / out.sum() if out.sum() else out

    def to_json(self) -> str:
        trees = [[t.feature, t.cut, t.left, t.value, t.gain, t.share] for t in self.trees]
        return json.dumps([self.base, trees, [c.tolist() for c in self.cuts], self.losses, self.depth, self.limits])

    @staticmethod
    def from_json(text: str) -> Boosted:
        base, trees, cuts, losses, depth, limits = json.loads(text)
        cuts = [np.array(c, dtype=float) for c in cuts]
        return Boosted(base, [Tree(*t) for t in trees], cuts, losses, depth, tuple(limits))


class Boost(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over a vector column. ``settings`` are ``BoostParams`` as JSON; rows are weighted
    by the column ``weight``, if it is named."""

    settings: Param[str] = Param(Params._dummy(), "settings", "boosting parameters", TypeConverters.toString)
    weight: Param[str] = Param(Params._dummy(), "weight", "column of weights, or empty", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", labelCol="label", settings="{}", weight=""):
        super().__init__()
        self._setDefault(settings="{}", weight="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> BoostModel:
        params = BoostParams(**json.loads(self.getOrDefault(self.settings)))
        weight = self.getOrDefault(self.weight)
        weights = [F.col(weight).alias("w")] if weight else []
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).alias("y"), *weights)
        found = boost(rows, "x", "y", params, "w" if weight else None)
        return BoostModel(featuresCol=self.getFeaturesCol(), loss=params.loss, ensemble=found.to_json())


class BoostModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``prediction``: a positive mean (Tweedie), a mean (squared) or a class, the latter
    beside ``probability``, a vector of both classes."""

    loss: Param[str] = Param(Params._dummy(), "loss", "the loss", TypeConverters.toString)
    ensemble: Param[str] = Param(Params._dummy(), "ensemble", "the fitted trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, featuresCol="features", loss="tweedie", ensemble=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @property
    def fitted(self) -> Boosted:
        return Boosted.from_json(self.getOrDefault(self.ensemble))

    @property
    def numFeatures(self) -> int:
        return len(self.fitted.cuts)

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.fitted.importances())

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = self.fitted

        @pandas_udf("double")
        def margin(rows: pd.Series) -> pd.Series:
            if not len(rows):
                return pd.Series([], dtype=float)
            return pd.Series(np.clip(found.margins(np.vstack(rows.to_numpy())), *found.limits))

        f = margin(vector_to_array(self.getFeaturesCol()))
        loss = self.getOrDefault(self.loss)
        if loss == "logistic":
            p = F.col("_p")
            both = dataset.withColumn("_p", 1 / (1 + F.exp(-f))).withColumns(
                {"probability": array_to_vector(F.array(1 - p, p)), "prediction": (p > 0.5).cast("double")}
            )
            return both.drop("_p")
        return dataset.withColumn("prediction", F.exp(f) if loss == "tweedie" else f)


def mean_deviance(df: DataFrame, actual: str, predicted: str, power: float) -> float:
    """Mean Tweedie deviance of positive predictions; negative values count as 0."""
    y, mu = F.greatest(F.col(actual), F.lit(0.0)), F.col(predicted)
    terms = [
        F.pow(y, F.lit(2 - power)) / ((1 - power) * (2 - power)),
        -y * F.pow(mu, F.lit(1 - power)) / (1 - power),
        F.pow(mu, F.lit(2 - power)) / (2 - power),
    ]
    return df.agg((2 * F.avg(reduce(lambda a, b: a + b, terms)))).first()[0]
