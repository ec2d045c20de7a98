"""Connected components of links that are spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import materialise

#: Rows of numbers that one task writes; tables of ids are written in as few tasks as that needs.
TASK_ROWS = 200_000


def written(df: DataFrame, rows: int) -> DataFrame:
    """Write ``df``, which has about ``rows`` short rows, by a number of tasks that fits them.

    A shuffle of a small table has as many partitions as one of a large table; merging them
    before the write saves a task and a file for each.
    """
    return materialise(df.coalesce(max(1, -(-rows // TASK_ROWS))))


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One round: each node hands its smallest neighbour to the larger (or smaller) ones."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    told = both.join(least, "a")
    if large:
        out = told.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return written(out.filter("a <> b").distinct(), rows)


def _is_flat(edges: DataFrame) -> bool:
    """Whether each node has one edge, and none leads to a node that has an edge itself."""
    counts = edges.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
    if counts[0] != counts[1]:
        return False
    inner = edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi")
    return inner.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of each node in ``links`` (``a``, ``b``).

    Alternating large and small stars (Kiveris et al., 2014): rounds grow with the logarithm
    of the longest chain. Each round is written. Links of a node to itself are left out.
    """
    edges = materialise(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    rows = edges.count()
    while not _is_flat(edges):
        edges = _star(_star(edges, True, 2 * rows), False, 2 * rows)
    # Every edge now leads to the smallest node.
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
