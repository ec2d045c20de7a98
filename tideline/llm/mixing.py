"""Mixing sources to target weights by the cube method.

Each source has a target of tokens; its rate is target / size. Every document is taken
floor(rate) times, and once more with the fractional part as inclusion probability. Which
documents get the extra copy is drawn by the cube method (Deville and Tillé): the vector of
probabilities moves at random along directions in the null space of the constraints "tokens
of the source" and "documents of the source", until a coordinate reaches 0 or 1; this keeps
both totals exactly. With two constraints three undecided documents are enough for a direction
(a cross product), so a flight is one pass over the rows with at most two left undecided.

Flights run on blocks of a source, and the documents left undecided (at most two per block)
fly again in larger blocks until each source has one block. Only then is there a landing: the
last two documents of a source are rounded to the pair that is nearest in tokens, and single
decisions of that last block are turned over while that brings the total nearer. No source is
held in one task, and only undecided documents move between rounds.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, VariantType

from tideline.llm.registry import named, query, table
from tideline.llm.rows import free_names
from tideline.session import materialise

BLOCK_ROWS = 4096
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
_EPS = 1e-9


def words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in ``text``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
) -> DataFrame:
    """Target of each source: ``source``, ``source_size``, ``target``.

    Sources by code point, null last, weigh ``weights``, repeating. They share ``share`` of all
    sizes by weight; a target stops at ``most`` times the size of its source, and the excess is
    shared again by weight among the others until none is above. The level at which that ends
    is found from running totals over sources ordered by how soon they are full: one row per
    source, whatever the number of documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(order) - 1) % len(weights)).cast("int")
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), place + 1))
    full = F.col("source_size") * F.lit(most)
    soon = W.orderBy(full / F.col("weight"), F.col("source").asc_nulls_first())
    before = soon.rowsBetween(W.unboundedPreceding, -1)
    after = soon.rowsBetween(0, W.unboundedFollowing)
    everything = F.sum("source_size").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    # The level if all sources before this one are full and the rest are not.
    level = (everything * F.lit(share) - F.coalesce(F.sum(full).over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(after)
    stepped = weighed.withColumns({"full": full, "level": level})
    is_open = F.col("level") * F.col("weight") < F.col("full")
    whole = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    final = F.min(F.when(is_open, F.struct(F.col("full") / F.col("weight"), F.col("level").alias("level")))).over(whole)
    return stepped.withColumn("final", final["level"]).select(
        "source",
        "source_size",
        F.least("full", F.coalesce(F.col("final") * F.col("weight"), F.col("full"))).alias("target"),
    )


def _draw(*parts: object) -> float:
    """A number in [0, 1) fixed by ``parts``."""
    mark = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest()
    return int.from_bytes(mark, "little") / 2.0**64


def fly(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, keeping sum(prob) and sum(prob * size); at most two are
    left undecided (three have a direction)."""
    out = prob.astype(float).copy()
    held: list[int] = []
    draws = iter(rng.random(4 * len(out) + 16))
    for i in range(len(out)):
        if _EPS < out[i] < 1 - _EPS:
            held.append(i)
        else:
            out[i] = round(out[i])
        while len(held) >= 3 or (len(held) == 2 and size[held[0]] == size[held[1]]):
            a, b = held[0], held[1]
            if len(held) == 2:
                units, way = (a, b), (1.0, -1.0)
            else:
                c = held[2]
                units = (a, b, c)
                way = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
                if not any(way):
                    way = (1.0, -1.0, 0.0)
            up = min((((1 - out[u]) / w) if w > 0 else (-out[u] / w)) for u, w in zip(units, way) if w)
            down = min(((out[u] / w) if w > 0 else ((out[u] - 1) / w)) for u, w in zip(units, way) if w)
            step = up if next(draws) * (up + down) < down else -down
            for u, w in zip(units, way):
                out[u] += step * w
            for u in units:
                if out[u] <= _EPS or out[u] >= 1 - _EPS:
                    out[u] = round(out[u])
                    held.remove(u)
    return out


def land(prob: np.ndarray, size: np.ndarray, flips: int = 32) -> np.ndarray:
    """Round the undecided (few) so that their tokens, then their number, change least, and
    turn over single decisions of the block while that brings the tokens nearer."""
    out = prob.copy()
    left = [i for i in range(len(out)) if _EPS < out[i] < 1 - _EPS]
    tokens, number = sum(out[i] * size[i] for i in left), sum(out[i] for i in left)
    best, pick = (math.inf, math.inf, 0), 0
    for mask in range(1 << len(left)):
        on = [left[j] for j in range(len(left)) if mask >> j & 1]
        off = (abs(tokens - sum(size[i] for i in on)), abs(number - len(on)), mask)
        if off < best:
            best, pick = off, mask
    for j, i in enumerate(left):
        out[i] = float(pick >> j & 1)
    over = sum(out[i] * size[i] for i in left) - tokens
    for _ in range(flips):
        after = np.abs(over + np.where(out > 0.5, -size, size))
        i = int(after.argmin()) if len(after) else 0
        if not len(after) or after[i] >= abs(over):
            break
        over += -size[i] if out[i] > 0.5 else size[i]
        out[i] = 1.0 - out[i]
    return out


_FLOWN = "source string, has_source boolean, key long, id_text string, size long, prob double, twin long"


def _flight(last: bool, seed: int):
    def flown(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "id_text", "size", "twin"], kind="stable", na_position="first")
        # Probabilities and sizes in one fixed order and draws fixed by it: reruns agree.
        first = rows.iloc[0]
        rng = np.random.default_rng(int(_draw(seed, first.source, first.key, len(rows)) * 2**63))
        size = rows["size"].to_numpy(float)
        prob = fly(rows["prob"].to_numpy(float), size, rng)
        return rows.assign(prob=land(prob, size) if last else prob)[
            ["source", "has_source", "key", "id_text", "size", "prob", "twin"]
        ]

    return flown


def cube_sample(docs: DataFrame, block_rows: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """Decide an extra copy (``prob`` 0.0 or 1.0) for each row of ``docs``.

    ``docs``: ``source``, ``id_text`` (null allowed), ``twin`` (number among rows that are alike
    in id, source and size), ``size``, ``prob``. Rows with the same ``id_text`` and ``twin`` in
    one source are told apart by ``size``. A block holds about ``block_rows`` rows.
    """
    keyed = docs.select(
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNotNull().alias("has_source"),
        F.xxhash64("id_text", "size", "twin").alias("key"),
        "id_text",
        "size",
        "prob",
        "twin",
    )
    undecided = (F.col("prob") > _EPS) & (F.col("prob") < 1 - _EPS)
    current, settled = materialise(keyed), []
    while True:
        settled.append(current.filter(~undecided))
        counts = materialise(
            current.filter(undecided)
            .groupBy("source", "has_source")
            .agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("blocks"))
        )
        most = counts.agg(F.max("blocks")).first()[0]
        if not most:
            break
        flying = current.filter(undecided).join(counts, ["source", "has_source"])
        block = F.pmod(F.xxhash64("key", F.lit(len(settled))), F.col("blocks"))
        current = materialise(
            flying.withColumn("block", F.when(F.col("blocks") > 1, block).otherwise(0))
            .groupBy("source", "has_source", "block", "blocks")
            .applyInPandas(_landing_last(seed), _FLOWN)
        )
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.withColumn("prob", F.round("prob"))


def _landing_last(seed: int):
    """Fly a block; land too where the block is all that is undecided in its source."""
    plain, landing = _flight(False, seed), _flight(True, seed)

    def flown(rows: pd.DataFrame) -> pd.DataFrame:
        return (landing if rows["blocks"].iloc[0] == 1 else plain)(rows)

    return flown


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """How often each document goes into the mix: ``id``, ``source``, ``size``,
    ``source_size``, ``target``, ``copies`` (0 to ``most``, at most 2 by default).

    One row per input row. Null text has size 0 and, like any text without words, no copies.
    A null source is a source of its own. Rows alike in id, source and size are separate
    documents, each with its own copies. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    sized = materialise(
        docs.select(
            named(id_col).alias("id"),
            named(source_col).cast("string").alias("source"),
            words(named(text_col).cast("string")).alias("size"),
        )
    )
    totals = materialise(
        source_targets(
            sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most
        ).select(
            F.coalesce("source", F.lit("")).alias("source"),
            F.col("source").isNotNull().alias("has_source"),
            "source_size",
            "target",
        )
    )
    # Alike rows are numbered after they are counted, so a row that is repeated often is one row.
    alike = sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    one = alike.select(
        "id",
        F.coalesce("source", F.lit("")).alias("source"),
        F.col("source").isNotNull().alias("has_source"),
        "size",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("twin"),
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = materialise(
        one.join(totals, ["source", "has_source"]).withColumn(
            "rate", F.when(F.col("size") > 0, F.least(rate, F.lit(most))).otherwise(0.0)
        )
    )
    drawn = cube_sample(
        rated.select(
            F.when(F.col("has_source"), F.col("source")).alias("source"),
            F.col("id").cast("string").alias("id_text"),
            "twin",
            "size",
            (F.col("rate") - F.floor("rate")).alias("prob"),
        ),
        block_rows,
    )
    d, r = drawn.alias("d"), rated.alias("r")
    same = [
        F.col("d.id_text").eqNullSafe(F.col("r.id").cast("string")),
        F.col("d.size") == F.col("r.size"),
        F.col("d.twin") == F.col("r.twin"),
        F.col("d.source") == F.col("r.source"),
        F.col("d.has_source") == F.col("r.has_source"),
    ]
    return r.join(d, same).select(
        "r.id",
        F.when(F.col("r.has_source"), F.col("r.source")).alias("source"),
        "r.size",
        "r.twin",
        "source_size",
        "target",
        (F.floor("rate") + F.col("d.prob")).cast("long").alias("copies"),
    )


def mixed_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    **settings,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as they were, whatever their
    names.

    Rows alike in id, source and size share their copies: those get theirs first whose text,
    then whose plain columns have the smaller hash, so a task that runs again decides alike.
    """
    at_id, at_source, at_size, at_twin, copies, source, size, twin, again = free_names(
        docs,
        *("_mix_id", "_mix_source", "_mix_size", "_mix_twin", "_mix_copies"),
        *("_source", "_size", "_twin", "_again"),
    )
    counted = (
        mix(docs, id_col, text_col, source_col, **settings)
        .filter("copies > 0")
        .select(
            F.col("id").alias(at_id),
            F.col("source").alias(at_source),
            F.col("size").alias(at_size),
            F.col("twin").alias(at_twin),
            F.col("copies").alias(copies),
        )
    )
    plain = [
        named(f.name)
        for f in docs.schema.fields
        if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)
    ]
    alike = W.partitionBy(named(id_col), F.col(source), F.col(size)).orderBy(
        F.xxhash64(named(text_col).cast("string")), F.xxhash64(*plain)
    )
    marked = docs.withColumns(
        {
            source: named(source_col).cast("string"),
            size: words(named(text_col).cast("string")),
        }
    ).withColumn(twin, F.row_number().over(alike).cast("long"))
    same = [
        named(id_col).eqNullSafe(F.col(at_id)),
        F.col(source).eqNullSafe(F.col(at_source)),
        F.col(size) == F.col(at_size),
        F.col(twin) == F.col(at_twin),
    ]
    joined = marked.join(counted, same)
    return joined.withColumn(
        again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    ).select(*[named(c) for c in docs.columns])


@query("op2_cube_mixing")
def op2_cube_mixing(spark, sf_dir):
    found = mix(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )
