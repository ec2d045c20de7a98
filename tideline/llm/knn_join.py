"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data are assigned to the nearest of a bounded set of pivots, rows of the data that
stand in the middle of balanced cells. A cell is summarised by the distances of its nearest
members to the pivot, and is cut into rings of distance with an outer radius each. With a query
q, the pivot c of a cell and a row x at distance d from it,

    q.c - |q| d  <=  q.x  <=  q.c + |q| d,

so the summaries alone give every query a score that its k-th best cannot fall below, and a
distance per cell from which rows can still reach it. The least of these distances over a group
of queries says which rows the group is sent; a query is sent only to those slabs of its group
that hold a ring within its own bound. Each group then scores the rows sent to it in bounded
slabs, and the best k of the slabs are merged.

Nothing that grows with the data is collected: the driver sees (pivots x k) distances and
(pivots x rings) radii and counts. A group has about ``group_rows`` queries (a pivot with more has
several, near ones with few share one) and a ring with more than ``slab_rows`` rows is dealt over slabs, so a hot cell
is many tasks. A query that equals another row is a row like any other; only the query's own row
is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table
from tideline.session import materialise

PIVOTS = 64
GROUP_ROWS = 512
SLAB_ROWS = 50_000
#: Rings of a cell that has more rows than a slab.
RINGS = 16
SCALE = 1024
# Relative slack for bounds in floating point; scores themselves are whole numbers.
SLACK = 1e-9


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``id`` and ``vec``: floor(scale * x) of each component as long.

    Vectors that are null, empty or hold a null or non-finite component are left out, and so
    are null ids.
    """
    vec = named(vec_col)

    def sound(x: Column) -> Column:
        d = x.cast("double")
        return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))

    fine = vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(F.forall(vec, sound), F.lit(False))
    return rows.filter(fine & named(id_col).isNotNull()).select(
        named(id_col).cast("long").alias("id"),
        F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(scale)))).alias("vec"),
    )


def _stack(column: pd.Series, dim: int) -> np.ndarray:
    """Vectors as rows, padded with zeros to ``dim`` or to the longest of them."""
    vecs = column.to_list()
    dim = max([dim, *map(len, vecs)])
    if all(len(v) == dim for v in vecs):
        return np.vstack(vecs) if vecs else np.zeros((0, dim), dtype="int64")
    out = np.zeros((len(vecs), dim), dtype="int64")
    for row, vec in zip(out, vecs):
        row[: len(vec)] = vec
    return out


def _widened(points: np.ndarray, dim: int) -> np.ndarray:
    return np.pad(points, ((0, 0), (0, dim - points.shape[1])))


def _nearest(vecs: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (vecs**2).sum(1)[:, None] - 2 * vecs @ pivots.T + (pivots**2).sum(1)[None, :]
    cell = square.argmin(axis=1)
    return cell, np.linalg.norm(vecs - pivots[cell], axis=1)


def choose_pivots(data: DataFrame, pivots: int, rounds: int = 8) -> np.ndarray:
    """At most ``pivots`` rows, each in the middle of a cell of a bounded, repeatable sample.

    The sample is the ``8 * pivots`` rows of smallest hash. Cells start around the first of
    them, so that dense regions get many; after ``rounds`` of moving each centre to the mean of
    its cell, the row nearest to a centre is a pivot. (Means themselves would not do: on vectors
    of equal norm a mean of everything is nearest to nearly every row.)
    """
    sample = data.orderBy(F.xxhash64("id"), "id").limit(8 * pivots).collect()
    if not sample:
        return np.zeros((0, 0))
    points = _stack(pd.Series([r["vec"] for r in sample]), 0).astype(float)
    _, first = np.unique(points, axis=0, return_index=True)
    points = points[np.sort(first)]
    centres = points[:pivots].copy()
    for _ in range(rounds):
        cell, _ = _nearest(points, centres)
        held = np.bincount(cell, minlength=len(centres)) > 0
        centres = np.array([points[cell == c].mean(axis=0) for c in np.flatnonzero(held)])
    chosen = [int(((points - c) ** 2).sum(axis=1).argmin()) for c in centres]
    return points[sorted(set(chosen))]


def _assign(pivots: np.ndarray):
    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vecs = _stack(batch["vec"], pivots.shape[1]).astype(float)
                cell, dist = _nearest(vecs, _widened(pivots, vecs.shape[1]))
                yield batch.assign(cell=cell.astype("int32"), dist=dist)

    return assigned


class Slabs:
    """Rings of the cells and the slabs that hold them.

    ``rings``: per cell its first and its last distance and how many rings of equal width lie
    between; ``outer``: the largest distance in each (cell, ring) that has rows; ``first`` and
    ``parts``: its first slab and over how many it is dealt. Small rings share a slab.
    """

    def __init__(self, cells: dict[int, tuple[float, float, int]], slab_rows: int):
        self.cells, self.slab_rows = cells, slab_rows
        self.outer: dict[tuple[int, int], float] = {}
        self.first: dict[tuple[int, int], int] = {}
        self.parts: dict[tuple[int, int], int] = {}

    def ring(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        low, high, number = (np.array([self.cells[c][i] for c in cell.tolist()]) for i in range(3))
        width = np.where(high > low, high - low, 1.0)
        return np.clip(((dist - low) / width * number).astype(int), 0, number - 1)

    def lay(self, counted: list[tuple[int, int, int, float]]) -> None:
        at, room = -1, 0
        for cell, ring, rows, outer in sorted(counted):
            unit = (cell, ring)
            self.outer[unit], self.parts[unit] = outer, -(-rows // self.slab_rows)
            if rows > room or at < 0:
                at, room = at + 1, self.slab_rows
                self.first[unit] = at
                at += self.parts[unit] - 1
                room = self.slab_rows - rows if self.parts[unit] == 1 else 0
            else:
                self.first[unit] = at
                room -= rows


def bundles(asked: list[tuple[int, int]], pivots: np.ndarray, group_rows: int) -> list[tuple[int, int, int]]:
    """The group of each cell, and over how many parts the group is dealt: (cell, group, parts).

    ``asked`` has the number of queries of each cell. A cell with more than ``group_rows`` is a group
    of several parts; smaller ones share a group with near cells, so that a row that several of
    them need is sent once.
    """
    number, out, group, room = dict(asked), [], -1, 0
    left = sorted(number)
    at = left[0] if left else None
    while left:
        at = min(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        left.remove(at)
        parts = -(-number[at] // group_rows)
        if number[at] > room:
            group, room = group + 1, group_rows if parts == 1 else 0
        room -= number[at] if parts == 1 else 0
        out.append((at, group, parts))
    return out


def _ringed(slabs: Slabs):
    def ringed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                ring = slabs.ring(batch["cell"].to_numpy(), batch["dist"].to_numpy())
                yield batch[["cell", "dist"]].assign(ring=ring.astype("int32"))

    return ringed


def least_distances(
    queries: np.ndarray, pivots: np.ndarray, summary: dict[int, list[float]], far: float, k: int
) -> np.ndarray:
    """For each query and cell, the distance to the pivot from which a row may be among the k
    best; ``summary`` has distances of rows with different ids, ``far`` is the largest distance."""
    centre = queries @ pivots.T
    norm = np.linalg.norm(queries, axis=1)
    known = [(c, d) for c, dists in summary.items() for d in dists]
    least = np.full(centre.shape, -np.inf)
    if len(known) <= k:
        return least
    at, dist = np.array([c for c, _ in known]), np.array([d for _, d in known])
    lower = centre[:, at] - norm[:, None] * dist[None, :]
    # One more than k, as a query's own row is among the rows but is not its neighbour.
    floor = -np.partition(-lower, k, axis=1)[:, k]
    slack = SLACK * norm * (np.linalg.norm(pivots, axis=1).max() + far) + 1e-6
    some = norm > 0
    least[some] = ((floor - 2 * slack)[:, None] - centre)[some] / norm[some, None]
    return least


def _bounds(pivots: np.ndarray, summary: dict[int, list[float]], far: float, k: int):
    """Per group and cell the least distance of all its queries in the batch."""

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vecs = _stack(batch["vec"], pivots.shape[1]).astype(float)
                least = least_distances(vecs, _widened(pivots, vecs.shape[1]), summary, far, k)
                low = pd.DataFrame(least).groupby([batch["at"].to_numpy(), batch["part"].to_numpy()]).min()
                long = low.rename_axis(["at", "part"]).rename_axis(columns="cell").stack().rename("least").reset_index()
                yield long.astype({"at": "int32", "cell": "int32"})[["at", "part", "cell", "least"]]

    return bounded


def _ask(pivots: np.ndarray, summary: dict[int, list[float]], far: float, k: int, slabs: Slabs):
    """Queries with the slabs that hold a ring within their bound."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vecs = _stack(batch["vec"], pivots.shape[1]).astype(float)
            least = least_distances(vecs, _widened(pivots, vecs.shape[1]), summary, far, k)
            wanted: dict[int, np.ndarray] = {}
            for unit, outer in slabs.outer.items():
                need = outer >= least[:, unit[0]]
                for slab in range(slabs.first[unit], slabs.first[unit] + slabs.parts[unit]):
                    wanted[slab] = wanted[slab] | need if slab in wanted else need
            for slab, need in wanted.items():
                if need.any():
                    yield batch.loc[need, ["id", "vec", "at", "part"]].assign(slab=slab)

    return asked


def _place(slabs: Slabs):
    """The slab of each row."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                cell = batch["cell"].to_numpy()
                units = list(zip(cell.tolist(), slabs.ring(cell, batch["dist"].to_numpy()).tolist()))
                first = np.array([slabs.first[u] for u in units])
                parts = np.array([slabs.parts[u] for u in units])
                yield batch.assign(slab=(first + batch["id"].to_numpy() % parts).astype("int32"))

    return placed


def _solve(k: int):
    def best(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            rows = rows.sort_values("id", kind="stable")
            ids, vecs = rows["id"].to_numpy(), _stack(rows["vec"], 0)
            asked = _stack(queries["vec"], vecs.shape[1])
            vecs = _widened(vecs, asked.shape[1])
            # Below 2**53 sums are exact in floating point, in any order; beyond, as integers.
            longest = [np.sqrt((m.astype(float) ** 2).sum(axis=1).max()) for m in (vecs, asked)]
            if longest[0] * longest[1] < 2.0**53:
                vecs, asked = vecs.astype(float), asked.astype(float)
            for q, vec in zip(queries["id"].to_numpy(), asked):
                other = ids != q
                score = (vecs @ vec)[other].astype("int64")
                theirs = ids[other]
                take = min(k, len(score))
                if take:
                    # All rows at the k-th score, so that ties are settled by id below; an id
                    # that is repeated takes several places here, but one in the result.
                    kth = np.sort(score)[len(score) - take] if len(np.unique(theirs)) == len(theirs) else None
                    near = np.flatnonzero(score >= kth) if kth is not None else np.arange(len(score))
                    near = near[np.lexsort((theirs[near], -score[near]))]
                    pairs = list(dict.fromkeys(zip(theirs[near].tolist(), score[near].tolist())))[:k]
                    out["query_id"] += [q] * len(pairs)
                    out["vec_id"] += [i for i, _ in pairs]
                    out["score"] += [v for _, v in pairs]
        return pd.DataFrame(out)

    return lambda queries, rows: best(queries, rows)


def top_k(
    data: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    pivots: int = PIVOTS,
    group_rows: int = GROUP_ROWS,
    slab_rows: int = SLAB_ROWS,
    scale: int = SCALE,
) -> DataFrame:
    """The ``k`` rows of highest inner product for each query row: ``query_id``, ``rank``,
    ``vec_id``, ``score``; ties go to the smaller id. A query with fewer candidates gets all.

    ``is_query`` is a condition on ``id``. Unsound vectors (see ``whole_vectors``) take no part;
    of vectors of unequal length the shorter counts as padded with zeros. Scores have to fit in
    64 bits. Rows with the same id are one another's own row; of rows alike in id and score one
    is listed. No rows give no rows. Other columns of ``data`` are not read.
    """
    spark = data.sparkSession
    whole = whole_vectors(data, id_col, vec_col, scale)
    chosen = choose_pivots(whole, pivots)
    empty = "query_id long, rank int, vec_id long, score long"
    if not len(chosen):
        return spark.createDataFrame([], empty)
    schema = "id long, vec array<long>, cell int, dist double"
    placed = materialise(whole.mapInPandas(_assign(chosen), schema))

    # The nearest of each cell, every id once: first of every part of it, then of the cell.
    nearest = W.partitionBy("cell", "part").orderBy("dist")
    firsts = (
        placed.groupBy("id")
        .agg(F.min(F.struct("dist", "cell")).alias("near"))
        .select("near.cell", "near.dist", F.pmod(F.xxhash64("id"), F.lit(256)).alias("part"))
        .withColumn("place", F.row_number().over(nearest))
        .filter(F.col("place") <= k + 1)
        .withColumn("place", F.row_number().over(W.partitionBy("cell").orderBy("dist")))
        .filter(F.col("place") <= k + 1)
    )
    summary: dict[int, list[float]] = {}
    for row in firsts.select("cell", "dist").collect():
        summary.setdefault(row["cell"], []).append(row["dist"])

    slabs = cut_slabs(placed, slab_rows)
    far = max(high for _, high, _ in slabs.cells.values())
    asked = placed.filter(is_query).select("id", "vec", F.col("cell").alias("at"))
    per_cell = [tuple(r) for r in asked.groupBy("at").agg(F.count(F.lit(1))).collect()]
    dealt = spark.createDataFrame(bundles(per_cell, chosen, group_rows), "at int, grp int, parts long")
    grouped = asked.join(dealt, "at").select(
        "id", "vec", F.col("grp").alias("at"), F.pmod(F.xxhash64("id"), "parts").alias("part")
    )
    needs = materialise(
        grouped.mapInPandas(_bounds(chosen, summary, far, k), "at int, part long, cell int, least double")
        .groupBy("at", "part", "cell")
        .agg(F.min("least").alias("least"))
    )
    slabbed = placed.mapInPandas(_place(slabs), f"{schema}, slab int")
    sent = (
        slabbed.join(needs, "cell").filter(F.col("dist") >= F.col("least")).select("id", "vec", "at", "part", "slab")
    )
    asked_of = grouped.mapInPandas(
        _ask(chosen, summary, far, k, slabs), "id long, vec array<long>, at int, part long, slab int"
    )
    found = (
        asked_of.groupBy("at", "part", "slab")
        .cogroup(sent.groupBy("at", "part", "slab"))
        .applyInPandas(_solve(k), "query_id long, vec_id long, score long")
    )
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def cut_slabs(placed: DataFrame, slab_rows: int) -> Slabs:
    """Rings and slabs for rows with ``cell`` and ``dist``: two aggregates, at most ``RINGS`` rows
    a cell."""
    cells = placed.groupBy("cell").agg(
        F.min("dist").alias("low"), F.max("dist").alias("high"), F.count(F.lit(1)).alias("rows")
    )
    slabs = Slabs(
        {r["cell"]: (r["low"], r["high"], min(RINGS, -(-r["rows"] // slab_rows))) for r in cells.collect()}, slab_rows
    )
    rings = placed.select("cell", "dist").mapInPandas(_ringed(slabs), "cell int, dist double, ring int")
    counted = rings.groupBy("cell", "ring").agg(F.count(F.lit(1)).alias("rows"), F.max("dist").alias("outer"))
    slabs.lay([tuple(r) for r in counted.collect()])
    return slabs


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (
    PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query("op1_voronoi_knn", ORACLE)
def op1_voronoi_knn(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
