"""Ranks, running totals and exact quantiles over data of any size.

A window without a partition key, or one over a key that holds a third of all
rows, puts too much into one task. Here rows are laid out by a range shuffle
whose blocks are cut between rows, not between keys, so a hot key spreads over
many blocks. The layout is written out once, which fixes it. Windows then run
inside a block, and what a group has in earlier blocks is carried over: a block
continues at most one group, so there are no more carries than blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.session import materialise

# monotonically_increasing_id keeps the partition above bit 33.
_POSITION_BITS = 33
_SEQ, _BLOCK = "_seq", "_block"


def lay_out(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Write ``df`` in one total order; ``_seq`` grows along it, ``_block`` is its range."""
    laid = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_SEQ, F.monotonically_increasing_id())
    )
    return materialise(laid).withColumn(_BLOCK, F.shiftright(_SEQ, _POSITION_BITS))


def _join_carried(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of at most one row per block; nulls match nulls."""
    renamed = carried.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return rows.join(F.broadcast(renamed), condition, "left").drop(*[f"_r_{k}" for k in keys])


def running_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, Column],
    by: Sequence[str] = (),
    sizes: dict[str, str] | None = None,
) -> DataFrame:
    """Add running totals up to each row, in ``order`` within ``by``.

    ``totals`` maps new columns to summed values. ``sizes`` maps further new
    columns to the entry of ``totals`` whose total over the whole group they
    hold. ``order`` must have no ties: aggregate rows of one position first.
    """
    sizes = sizes or {}
    values = {f"_value_{name}": value for name, value in totals.items()}
    laid = lay_out(df.withColumns(values), [*[F.col(c) for c in by], *order])
    keys = [_BLOCK, *by]

    per_block = laid.groupBy(*keys).agg(*[F.sum(f"_value_{n}").alias(n) for n in totals])
    along = W.partitionBy(*by).orderBy(_BLOCK)
    earlier = along.rowsBetween(W.unboundedPreceding, -1)
    spans = W.partitionBy(*by)
    carried = per_block.select(
        *keys,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in totals],
        *[F.sum(source).over(spans).alias(f"_all_{name}") for name, source in sizes.items()],
        F.count(F.lit(1)).over(spans).alias("_blocks"),
    )
    # Groups inside one block carry nothing; at most two partial groups touch a block.
    carried = carried.filter(F.col("_blocks") > 1).drop("_blocks")

    inside = W.partitionBy(*keys)
    upto = inside.orderBy(_SEQ).rowsBetween(W.unboundedPreceding, 0)
    local = laid.withColumns(
        {
            **{f"_local_{n}": F.sum(f"_value_{n}").over(upto) for n in totals},
            **{f"_here_{n}": F.sum(f"_value_{s}").over(inside) for n, s in sizes.items()},
        }
    )
    joined = _join_carried(local, carried, keys)
    return joined.select(
        *df.columns,
        *[
            (F.col(f"_local_{n}") + F.coalesce(F.col(f"_carry_{n}"), F.lit(0))).alias(n)
            for n in totals
        ],
        *[F.coalesce(F.col(f"_all_{n}"), F.col(f"_here_{n}")).alias(n) for n in sizes],
    )


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "rank",
    by: Sequence[str] = (),
) -> DataFrame:
    """Add a 1-based rank in ``order`` within ``by``; ``order`` must have no ties."""
    if by:
        return running_totals(df, order, {name: F.lit(1).cast("long")}, by)
    laid = lay_out(df, order)
    per_block = laid.groupBy(_BLOCK).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = W.orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    starts = per_block.select(
        _BLOCK, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_carry")
    )
    position = F.col(_SEQ).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    ranked = _join_carried(laid, starts, [_BLOCK])
    return ranked.select(*df.columns, (F.col("_carry") + position + 1).alias(name))


def last_known(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null, up to each row in ``order``."""
    laid = lay_out(df, order)
    upto = W.partitionBy(_BLOCK).orderBy(_SEQ).rowsBetween(W.unboundedPreceding, 0)
    local = laid.withColumn("_local", F.last(value, ignorenulls=True).over(upto))
    ends = laid.filter(F.col(value).isNotNull()).groupBy(_BLOCK).agg(F.max_by(value, _SEQ).alias("_end"))
    # One row per block: every block, also those without a value.
    blocks = laid.select(_BLOCK).distinct().join(ends, _BLOCK, "left")
    earlier = W.orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(_BLOCK, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    joined = _join_carried(local, carried, [_BLOCK])
    return joined.select(*df.columns, F.coalesce("_local", "_carry").alias(name))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    by: Sequence[str] = (),
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group (one row if no ``by``)."""
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    placed = running_totals(
        counted, [F.col(value)], {"_upto": F.col("_n")}, by, sizes={"_size": "_upto"}
    )
    aggregates, results = [], []
    for name, probability in probabilities.items():
        parts, result = _interpolated(value, "_n", "_upto", "_size", probability, name)
        aggregates += parts
        results.append(result)
    return placed.groupBy(*by).agg(*aggregates).select(*by, *results)


def _interpolated(
    value: str, count: str, upto: str, size: str, probability: float, name: str
) -> tuple[list[Column], Column]:
    """Aggregates over placed values, and the quantile ``name`` made of them."""
    target = (F.col(size) - 1) * F.lit(float(probability))
    parts = []
    for side, position in (("lo", F.floor(target)), ("hi", F.ceil(target))):
        holds = (F.col(upto) - F.col(count) <= position) & (position < F.col(upto))
        parts.append(F.max(F.when(holds, F.col(value))).alias(f"_{side}_{name}"))
    parts.append(F.max(target - F.floor(target)).alias(f"_part_{name}"))
    lo, hi, part = (F.col(f"_{x}_{name}") for x in ("lo", "hi", "part"))
    return parts, (lo + (hi - lo) * part).alias(name)


def counted_quantiles(
    counted: DataFrame, value: str, counts: Sequence[str], probability: float, by: Sequence[str]
) -> DataFrame:
    """The quantile of ``value`` per group under each of several counts, from one layout.

    ``counted`` has one row per group and value, without nulls among the values. The result has
    a column per entry of ``counts``, under its name: null where the group has none of these.
    """
    upto, size = ({c: f"_{kind}_{c}" for c in counts} for kind in ("upto", "size"))
    placed = running_totals(
        counted,
        [F.col(value)],
        {upto[c]: F.col(c) for c in counts},
        by,
        sizes={size[c]: upto[c] for c in counts},
    )
    found = [_interpolated(value, c, upto[c], size[c], probability, c) for c in counts]
    aggregates = [part for parts, _ in found for part in parts]
    return placed.groupBy(*by).agg(*aggregates).select(*by, *[result for _, result in found])


def average_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value: its count and the mean 1-based rank of its ties."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, [F.col(value)], {"_upto": F.col("n")}, by)
    return placed.select(
        *by, value, "n", (F.col("_upto") - (F.col("n") - 1) / F.lit(2.0)).alias("average_rank")
    )


def spread_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    count: str,
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Inner join with one row of ``right`` per key, where one key may hold most of ``left``.

    ``right`` tells by ``count`` how many rows of ``left`` have the key. Only keys with more
    than ``rows_per_slice`` are spread, over as many slices as that takes; there are no more
    of them than rows of ``left`` divided by ``rows_per_slice``, which bounds the broadcast.
    """
    slices = F.ceil(F.col(count) / F.lit(rows_per_slice)).cast("int")
    sliced = right.withColumn("_slices", slices).drop(count)
    hot = sliced.filter("_slices > 1").select(*keys, "_slices")
    salt = F.pmod(F.xxhash64(*left.columns), F.coalesce("_slices", F.lit(1))).cast("int")
    salted = _join_carried(left, hot, keys).withColumn("_salt", salt).drop("_slices")
    spread = sliced.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    return salted.join(spread.drop("_slices"), [*keys, "_salt"]).drop("_salt")
