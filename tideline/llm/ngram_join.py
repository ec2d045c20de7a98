"""N-gram Jaccard self-join by a count-vector R-tree.

A document is the set of its distinct word shingles, kept as sorted 64-bit hashes. Hashing the
shingles into ``GROUPS`` groups makes it a point of group counts. Two sets share at most the
sum of the coordinate minima of their points, and a point and all points below a tree node at
most the sum of the minima with the node's upper corner; what cannot reach the overlap that the
similarity asks for is left out, and the pairs that survive are verified on the sets.

How the work is spread:

* Documents with the same set are one class; everything after that is about classes.
* The root of the tree is a routing that loses no pair. Sets of sizes a and b that are similar
  enough differ in at most D = (a + b)(1 - t) / (1 + t) shingles. The hash range is cut into
  D + 1 + e parts, so more than e parts have the same content in both, and at least one of
  these is not empty unless both sets have more than e empty parts (e is such that this is
  rare). Classes that share a part's content (its signature) stand in one region. Sizes are
  handled in overlapping ranges.
* Parts are a tenth more than that, so similar sets share as many signatures more than one. A class
  that shares fewer with all others together is similar to none; texts with a passage in common
  fall away here, before their sets are built.
* Signatures that occur once are dropped by a count and a bounded bitmap before classes are
  shuffled on them, a fixed share of all signatures at a time: the rest has no shuffle on disk.
  Regions are the connected components of "shares a signature".
* In a region all are first compared with its most common class. Those that are linked to it are
  in one component already and are not compared with one another.
* The rest of the tree: classes of a region, in order of size and counts, are cut into leaves
  of bounded total size with an upper corner each; leaf pairs whose bound reaches are work, and tiles
  of them are tasks.
  Inside a task, nodes of ``NODE`` points have corners too. A task returns a spanning forest
  of the links it verified, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.ordering import running_totals
from tideline.llm.bits import bitmap, has
from tideline.llm.graph import components, written
from tideline.llm.registry import named, query, table
from tideline.llm.rows import keep_rows
from tideline.session import discard, materialise

GROUPS = 64
NODE = 64
#: Shingles in a leaf (or one class, if that is larger) and in a task.
LEAF_SHINGLES = 400_000
TASK_SHINGLES = 4_000_000
#: Neighbouring leaves on either side of a tile of leaf pairs.
TOGETHER = 5
SIZE_STEP = 1.4
#: Sets that a task hands Python at once: a set is kilobytes, two of them are compared in a row.
BATCH_SETS = 500
#: Signatures are dealt into so many columns by their remainder and shuffled one column at a time.
PIECES = 4
#: One more part for each so many shingles by which similar sets may differ.
MORE_PARTS = 10

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 5
_CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * _CHUNK)
        with np.errstate(over="ignore"):
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                steps = np.full(size, base, dtype=_U)
                steps[0] = 1
                _POWERS.append(np.multiply.accumulate(steps))
        del _POWERS[:-2]
    return _POWERS[0], _POWERS[1]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+``, in order.

    Each (place, byte) of a word has a mixed value of its own, and these are added up. (A
    polynomial modulo 2**64 would not do: words that differ by a Thue-Morse pattern are equal
    under it, whatever its base.)
    """
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        while end < len(text) and not _SPACE[text[end]]:
            end += 1  # a word is not cut
        part = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        at = end
        space = _SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        if not len(edge):
            continue
        start, stop = edge[0::2], edge[1::2]
        size = stop - start
        first = np.cumsum(size) - size
        letter = part[~space].astype(_U)
        place = (np.arange(len(letter)) - np.repeat(first, size)).astype(_U)
        with np.errstate(over="ignore"):
            marks = mix((place * _U(256) + letter + _U(1)) * _U(_BASE))
            word = np.add.reduceat(marks, first)
            out.append(mix(word ^ (size.astype(_U) * _U(0xD6E8FEB86659FD93))))
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def shingle_set(text: str | None, width: int = 3) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a whole text, A-Z lower-cased; fewer
    words than ``width`` are one shingle, no words none."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        use = min(width, n)
        sums = np.full(n - use + 1, use, dtype=_U)
        for i in range(use):
            sums = mix(sums * _U(0x2545F4914F6CDD1D) + words[i : n - use + 1 + i])
    return np.unique(sums)


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    with np.errstate(over="ignore"):
        n = _U(len(shingles))
        one = mix(shingles ^ _U(0xA0761D6478BD642F)).sum(dtype=_U) + n
        two = mix(shingles ^ _U(0xE7037ED1A0B428DB)).sum(dtype=_U) - n
    return int(one.view(np.int64)), int(two.view(np.int64))


def _size_ranges(most: int) -> list[int]:
    """Lower ends of the size ranges up to beyond ``most``."""
    ends = [1]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, int(ends[-1] * SIZE_STEP)))
    return ends


_RANGES = np.array(_size_ranges(1 << 40), dtype=np.int64)


@lru_cache(maxsize=None)
def _parts(k: int, num: int, den: int) -> tuple[int, int, int]:
    """Number of parts for the sizes of range ``k``, how many of them may be empty by chance, and
    how many more a pair shares than one beside these."""
    apart = 2 * (int(_RANGES[k + 1]) - 1) * (den - num) // (den + num)
    if not apart:
        return 0, 0, 0
    least = int(_RANGES[k]) * num / den
    empty = (apart + 1) * math.exp(-least / (apart + 1))
    spare = 2 + math.ceil(empty + 3 * math.sqrt(empty))
    more = -(-apart // MORE_PARTS)
    return apart + 1 + spare + more, spare, more


def needed(n: int, num: int, den: int) -> int:
    """Signatures that a set of ``n`` shingles shares with each set similar to it, at least."""
    return 1 + _parts(int(np.searchsorted(_RANGES, max(n, 1), side="right")) - 1, num, den)[2]


def signatures(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of the parts, for the set's size range and the next if a partner may be in it."""
    n = len(shingles)
    own = int(np.searchsorted(_RANGES, n, side="right")) - 1
    out = []
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(mix(shingles ^ _U(0x8EBC6AF09C88C6E3)), out=sums[1:])
        for k in (own, own + 1):
            if k > own and n * den < num * int(_RANGES[k]):
                break
            parts, spare, _ = _parts(k, num, den)
            if not parts:
                continue  # only equal sets are similar enough, and these are one class
            cuts = [-(-i * (1 << 64) // parts) for i in range(1, parts)]
            ends = np.searchsorted(shingles, np.array(cuts, dtype=_U))
            ends = np.concatenate(([0], ends, [n]))
            count = np.diff(ends)
            number = np.arange(parts, dtype=_U) + _U(k << 40)
            sig = mix((sums[ends[1:]] - sums[ends[:-1]]) ^ mix(number * _U(0x9FB21C651E98DF25) + count.astype(_U)))
            # A pair shares more than ``spare`` parts: with no more empty ones, one is not empty.
            out.append(sig if (count == 0).sum() > spare else sig[count > 0])
    return np.concatenate(out) if out else np.zeros(0, dtype=_U)


def _dealt(sigs: np.ndarray) -> list[np.ndarray]:
    """The signatures of each piece."""
    piece = sigs % _U(PIECES)
    return [sigs[piece == p].view(np.int64) for p in range(PIECES)]


def _sketch(width: int, num: int, den: int):
    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at : at + 1024]
                sets = [shingle_set(t, width) for t in part["text"]]
                keys = [set_key(s) for s in sets]
                sigs = [_dealt(signatures(s, num, den)) for s in sets]
                yield pd.DataFrame(
                    {
                        "id": part["id"].to_numpy(),
                        "mark": part["mark"].to_numpy(),
                        "n": [len(s) for s in sets],
                        "k1": [k[0] for k in keys],
                        "k2": [k[1] for k in keys],
                        "needed": [needed(len(s), num, den) for s in sets],
                        **{f"s{p}": [s[p] for s in sigs] for p in range(PIECES)},
                    }
                )

    return sketched


def _shared_signatures(sketches: DataFrame, piece: int) -> DataFrame:
    """(sig, k1, k2) of signatures of a piece that at least two rows have, and a few by chance."""
    spark = sketches.sparkSession
    sketches = sketches.select("n", "k1", "k2", F.col(f"s{piece}").alias("sigs"))
    often = sketches.select(F.explode("sigs").alias("sig")).groupBy("sig").count().filter("count > 1")
    bits = spark.sparkContext.broadcast(bitmap(often, "sig"))

    def filtered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lengths = batch["sigs"].str.len().to_numpy(dtype=np.int64)
            if not lengths.sum():
                continue
            flat = np.concatenate(batch["sigs"].to_list()).astype(np.int64)
            keep = has(bits.value, flat)
            yield pd.DataFrame(
                {
                    "sig": flat[keep],
                    "k1": np.repeat(batch["k1"].to_numpy(), lengths)[keep],
                    "k2": np.repeat(batch["k2"].to_numpy(), lengths)[keep],
                }
            )

    rows = sketches.filter("n > 0").select("k1", "k2", "sigs")
    return rows.mapInPandas(filtered, "sig long, k1 long, k2 long").distinct()


def _members(sketches: DataFrame, classes: DataFrame, piece: int) -> DataFrame:
    """(sig, cid) of the signatures of a piece that at least two classes have; written."""
    met = _shared_signatures(sketches, piece).join(classes.select("k1", "k2", "cid"), ["k1", "k2"])
    met = materialise(met.select("sig", "cid"), BATCH_SETS)
    often = met.groupBy("sig").count().filter("count > 1").select("sig")
    shared = materialise(met.join(often, "sig", "left_semi"))
    discard(met)
    return shared


def _enough(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, cid) of the classes that share enough signatures to be similar to any other."""
    counted = shared.groupBy("cid").agg(F.count(F.lit(1)).alias("shares"))
    enough = counted.join(classes.select("cid", "needed"), "cid").filter("shares >= needed")
    return shared.join(enough.select("cid"), "cid", "left_semi")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``wanted`` classes with their sets (``shingles``: sorted hashes as bytes) and counts.

    The texts are read again; a bounded bitmap of representative ids leaves most rows out
    before they are cut into shingles, and the join on the class decides.
    """
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64("rep").alias("h")), "h"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[has(bits.value, batch["h"].to_numpy())]
            for at in range(0, len(batch), 256):
                sets = [shingle_set(t, width) for t in batch["text"].iloc[at : at + 256]]
                keys = [set_key(s) for s in sets]
                yield pd.DataFrame(
                    {
                        "k1": [k[0] for k in keys],
                        "k2": [k[1] for k in keys],
                        "shingles": [s.tobytes() for s in sets],
                        "counts": [_counts(s) for s in sets],
                    }
                )

    texts = docs.select(F.xxhash64("id").alias("h"), "text")
    sets = texts.mapInPandas(cut, "k1 long, k2 long, shingles binary, counts array<int>")
    # One class, one key: rows of a class lie together after the join and move no further.
    return wanted.join(sets, ["k1", "k2"]).dropDuplicates(["k1", "k2"])


def _counts(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles & _U(GROUPS - 1)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Number of common values of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = _shared(a, b)
    return den * both >= num * (len(a) + len(b) - both)


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def leaf_links(
    sets: list[np.ndarray], counts: np.ndarray, side: np.ndarray, linked: np.ndarray, num: int, den: int
) -> list[tuple[int, int]]:
    """A spanning forest of the links between the points of one leaf pair.

    ``side`` has bit 1 for points of the first leaf and bit 2 for the second (3: a leaf with
    itself). ``linked`` points are one component from the start and are not compared.
    """
    size = np.array([len(s) for s in sets])
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    forest, out = _Forest(len(sets)), []
    known = np.flatnonzero(linked)
    for x in known[1:]:
        forest.join(int(known[0]), int(x))
    corners = [
        (right[i : i + NODE], counts[right[i : i + NODE]].max(axis=0), size[right[i : i + NODE]].min(), size[right[i : i + NODE]].max())
        for i in range(0, len(right), NODE)
    ]
    high = np.array([c[1] for c in corners]) if corners else np.zeros((0, GROUPS))
    low_n = np.array([c[2] for c in corners])
    high_n = np.array([c[3] for c in corners])
    for i in left:
        n = size[i]
        # den * o >= num * (n + m - o), and o is at most the sum of the minima.
        reach = np.minimum(high, counts[i]).sum(axis=1)
        go = ((den + num) * reach >= num * (n + low_n)) & (low_n * num <= n * den) & (high_n * den >= n * num)
        for k in np.flatnonzero(go):
            points = corners[k][0]
            bound = np.minimum(counts[points], counts[i]).sum(axis=1)
            near = points[((den + num) * bound >= num * (n + size[points])) & (points != i)]
            for j in near:
                i_, j_ = int(i), int(j)
                if side[i] == 3 and side[j] == 3 and j_ < i_:
                    continue
                if forest.find(i_) != forest.find(j_) and _similar(sets[i_], sets[j_], num, den):
                    forest.join(i_, j_)
                    out.append((i_, j_))
    return out


def _solve(num: int, den: int):
    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        rows = rows.sort_values(["n", "cid"], kind="stable")
        every = [np.frombuffer(x, dtype=_U) for x in rows["shingles"]]
        all_counts, all_cid = np.vstack(rows["counts"].to_list()), rows["cid"].to_numpy()
        all_linked = rows["linked"].to_numpy(dtype=bool)
        members: dict[int, list[tuple[int, int]]] = {}
        for i, (pairs, sides) in enumerate(zip(rows["pairs"], rows["sides"])):
            for pair, side in zip(pairs, sides):
                members.setdefault(int(pair), []).append((i, int(side)))
        for pair in sorted(members):
            at = np.array([i for i, _ in members[pair]])
            side = np.array([s for _, s in members[pair]])
            cid = all_cid[at]
            found = leaf_links([every[i] for i in at], all_counts[at], side, all_linked[at], num, den)
            a += [cid[i] for i, _ in found]
            b += [cid[j] for _, j in found]
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return solved


def _region_links(points: DataFrame, num: int, den: int) -> DataFrame:
    """Links (``a``, ``b``) inside regions, a spanning forest of them.

    ``points``: ``cid``, ``region``, ``n``, ``copies``, ``shingles``, ``counts``; written.
    """
    centre = points.groupBy("region").agg(
        F.max(F.struct("copies", (-F.col("cid")).alias("cid"))).alias("best")
    )
    number = points.count()
    centre = written(centre.select("region", (-F.col("best.cid")).alias("cid")), number)
    hub = materialise(
        points.join(centre, ["region", "cid"]).select(
            "region", F.col("cid").alias("hub"), F.col("shingles").alias("hub_shingles")
        )
    )

    @F.pandas_udf("boolean")
    def like(one: pd.Series, two: pd.Series) -> pd.Series:
        return pd.Series(
            [
                _similar(np.frombuffer(x, dtype=_U), np.frombuffer(y, dtype=_U), num, den)
                for x, y in zip(one, two)
            ]
        )

    compared = materialise(
        points.join(hub, "region").select(
            "cid", "region", "n", "counts", "hub", like("shingles", "hub_shingles").alias("linked")
        ),
        BATCH_SETS,
    )
    to_hub = compared.filter(F.col("linked") & (F.col("cid") != F.col("hub"))).select(
        F.col("hub").alias("a"), F.col("cid").alias("b")
    )
    # A region in which all are linked to its centre is done.
    open_regions = written(compared.filter(~F.col("linked")).select("region").distinct(), number)
    placed = running_totals(
        compared.join(open_regions, "region", "left_semi").select("cid", "region", "n", "linked", "counts"),
        [F.col("n"), F.col("counts"), F.col("cid")],
        {"upto": F.col("n")},
        by=["region", "linked"],
    )
    leaf = F.floor((F.col("upto") - F.col("n")) / LEAF_SHINGLES)
    leaves = written(placed.withColumn("leaf", leaf).drop("upto"), number)

    corner = F.transform(
        F.sequence(F.lit(0), F.lit(GROUPS - 1)), lambda g: F.get("counts", g)
    )
    exploded = leaves.select("region", "linked", "leaf", "n", F.posexplode(corner).alias("g", "count"))
    tops = exploded.groupBy("region", "linked", "leaf", "g").agg(
        F.max("count").alias("count"), F.min("n").alias("low"), F.max("n").alias("high")
    )
    nodes = written(
        tops.groupBy("region", "linked", "leaf").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("g", "count"))), lambda x: x["count"]).alias("top"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        ),
        number,
    )
    x, y = nodes.alias("x"), nodes.alias("y")
    reach = F.aggregate(
        F.zip_with("x.top", "y.top", lambda a, b: F.least(a, b)), F.lit(0).cast("long"), lambda s, v: s + v
    )
    in_order = F.struct("x.linked", "x.leaf") <= F.struct("y.linked", "y.leaf")
    pairs = written(
        x.join(y, [F.col("x.region") == F.col("y.region"), in_order, ~(F.col("x.linked") & F.col("y.linked"))])
        .filter((den + num) * reach >= num * (F.col("x.low") + F.col("y.low")))
        .filter((F.col("x.low") * num <= F.col("y.high") * den) & (F.col("y.low") * num <= F.col("x.high") * den))
        .select(
            "x.region",
            F.monotonically_increasing_id().alias("pair"),
            F.xxhash64(
                "x.region", F.floor(F.col("x.leaf") / TOGETHER), F.floor(F.col("y.leaf") / TOGETHER), "x.linked", "y.linked"
            ).alias("tile"),
            F.array(
                F.struct(F.col("x.linked").alias("linked"), F.col("x.leaf").alias("leaf"), F.lit(1).alias("side")),
                F.struct(F.col("y.linked").alias("linked"), F.col("y.leaf").alias("leaf"), F.lit(2).alias("side")),
            ).alias("ends"),
        )
        .select("region", "pair", "tile", F.explode("ends").alias("end"))
        .groupBy("region", "pair", "tile", F.col("end.linked").alias("linked"), F.col("end.leaf").alias("leaf"))
        .agg(F.sum("end.side").cast("int").alias("side")),
        number,
    )
    where = leaves.select("cid", "region", "linked", "leaf", "n").join(pairs, ["region", "linked", "leaf"])
    # Leaf pairs of a tile are one piece of work, to which a point is sent once.
    where = where.groupBy("tile", "cid").agg(
        F.first("linked").alias("linked"),
        F.first("n").alias("n"),
        F.collect_list(F.struct("pair", "side")).alias("ends"),
    )
    ends = [F.col(f"ends.{name}").alias(f"{name}s") for name in ("pair", "side")]
    where = written(where.select("tile", "cid", "linked", "n", *ends), number)
    total = where.agg(F.sum("n")).first()[0] or 0
    work = points.join(where.drop("n"), "cid")
    tasks = max(1, -(-total // TASK_SHINGLES))
    inside = materialise(
        work.withColumn("task", F.pmod("tile", F.lit(tasks)))
        .select("task", "pairs", "sides", "linked", "cid", "n", "shingles", "counts")
        .groupBy("task")
        .applyInPandas(_solve(num, den), "a long, b long"),
        BATCH_SETS,
    )
    return to_hub.unionByName(inside)


def _component_rows(
    docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int
) -> DataFrame:
    """Rows with ``id``, ``mark`` (hash of the text), ``n``, ``component`` (null without
    shingles) and ``component_id``; written."""
    slim = docs.select(
        named(id_col).cast("long").alias("id"), named(text_col).cast("string").alias("text")
    )
    read = slim.select(F.col("id").cast("string").alias("id"), F.xxhash64("text").alias("mark"), "text")
    pieces = ", ".join(f"s{p} array<long>" for p in range(PIECES))
    schema = f"id string, mark long, n long, k1 long, k2 long, needed int, {pieces}"
    sketches = materialise(
        read.mapInPandas(_sketch(width, num, den), schema).withColumn("id", F.col("id").cast("long")),
        2 * BATCH_SETS,
    )
    number = sketches.count()
    rows = written(sketches.select("id", "mark", "n", "k1", "k2", "needed"), number)
    classes = written(
        rows.filter("n > 0")
        .groupBy("k1", "k2")
        .agg(
            F.min("id").alias("rep"),
            F.max("n").alias("n"),
            F.max("needed").alias("needed"),
            F.count(F.lit(1)).alias("copies"),
        )
        .withColumn("cid", F.monotonically_increasing_id()),
        number,
    )
    shared = [_members(sketches, classes, piece) for piece in range(PIECES)]
    discard(sketches)
    members = materialise(_enough(reduce(DataFrame.unionByName, shared), classes))
    for piece in shared:
        discard(piece)
    hubs = members.groupBy("sig").agg(F.min("cid").alias("a"), F.count(F.lit(1)).alias("size"))
    hubs = written(hubs.filter("size > 1"), members.count())
    near = members.join(hubs, "sig").select("a", F.col("cid").alias("b"))
    regions = written(components(near), number)
    wanted = classes.join(regions.withColumnsRenamed({"node": "cid", "component": "region"}), "cid")
    points = materialise(_sets_of(slim, wanted, width), BATCH_SETS)
    links = _region_links(points, num, den)
    joined = components(links).withColumnsRenamed({"node": "cid"})
    whole = written(
        classes.join(joined, "cid", "left").select(
            "k1", "k2", "rep", F.coalesce("component", "cid").alias("component")
        ),
        number,
    )
    least = written(whole.groupBy("component").agg(F.min("rep").alias("component_id")), number)
    found = written(
        whole.join(least, "component").select("k1", "k2", "component", "component_id"), number
    )
    rows = rows.select("id", "mark", "n", "k1", "k2")
    alone = rows.filter("n = 0").select(
        "id", "mark", "n", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id")
    )
    linked = rows.filter("n > 0").join(found, ["k1", "k2"])
    return written(
        linked.select("id", "mark", "n", "component", "component_id").unionByName(alone), number
    )


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    num: int = 90,
    den: int = 100,
) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` of each row; two rows are linked when the
    Jaccard similarity of their shingle sets is at least ``num / den``.

    The component's id is the smallest id in it. Rows without words (also null texts) have no
    shingles and are linked with nothing. Ids are integers; a null id is never the smallest, and
    a component of null ids only has the id null. Rows with the same id are rows of their own.
    An empty table gives no rows. Other columns are not read.
    """
    rows = _component_rows(docs, id_col, text_col, width, num, den)
    return rows.select("id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    num: int = 80,
    den: int = 100,
) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest id (then of the smallest
    hash of the text); columns as they were. Rows without words stay."""
    rows = _component_rows(docs, id_col, text_col, width, num, den).filter("component is not null")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "mark")
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    judged = rows.join(first, "component").select(
        "id",
        "mark",
        (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))).alias("kept"),
    )
    text = named(text_col).cast("string")
    has_words = F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = keep_rows(docs.filter(has_words), id_col, F.xxhash64(text), judged)
    return kept.unionByName(docs.filter(~has_words))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, sf_dir):
    found = similar_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
