"""Removal of long byte strings that occur more than once, by suffix arrays.

A byte goes when it lies in a string of ``length`` bytes that also starts anywhere else.
The strings ("windows") are dealt out so that equal ones meet:

* Each window picks the leftmost smallest of the hashed ``GRAM``-byte strings in it, its anchor
  (winnowing). Equal windows have equal anchors at the same place. Neighbouring windows mostly
  share an anchor; the bytes under them are the anchor's context.
* Equal contexts are merged and counted before anything is shuffled, so a text that a third of
  all rows copy is one context. Anchors that occur once cannot have equal windows; a count and
  a bounded bitmap leave them out.
* Contexts of the anchors that have different contexts go to shards of bounded size by
  anchor. Each shard builds its suffix array by induced sorting and the permuted array of
  common prefixes; neighbours in the array with a common prefix of ``length`` or more are equal
  windows. An anchor with very many different contexts (a passage in very many texts) is not
  held in one shard. Its windows are cut into cells by their distance to the anchor; all windows
  of a cell hold the bytes around the anchor that its outermost windows share, so only contexts
  with the same such bytes can have equal ones. Of these, parts with the same bytes are one kind,
  and the kinds go to shards. Only where more than that many kinds are left are windows counted
  one by one, over all tasks.
* The spans found go back to the documents; only texts that may lose something are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bits import bitmap, has
from tideline.llm.ngram_join import _powers, mix
from tideline.llm.registry import named, query, table
from tideline.session import materialise

LENGTH = 400
GRAM = 32
#: Bytes that a task looks at together; longer texts are cut into overlapping pieces.
PIECE = 1 << 18
#: Bytes of contexts in a shard, and contexts of one anchor up to which a shard holds them.
SHARD_BYTES = 1_000_000
ANCHOR_CONTEXTS = 2_000
#: Windows of a cell, of an anchor with more contexts than that.
CELL = 32

_U = np.uint64
_POSITION_BITS = 21


# --- induced sorting -------------------------------------------------------------------


def _later(positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``positions`` that end their runs of one character, with the rest of the runs, in the
    order in which one induces the next: all at distance 0, then all at distance 1, ..."""
    reach = positions - first[positions]
    if not len(reach) or not reach.any():
        return positions
    count = reach + 1
    owner = np.repeat(np.arange(len(positions)), count)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    order = np.argsort(step, kind="stable")
    return (positions[owner] - step)[order]


def _deal(text: np.ndarray, positions: np.ndarray, into: dict[int, list[np.ndarray]], c: int, up: bool) -> None:
    """Hand the positions before ``positions`` to the buckets of their characters, if these
    are above (``up``) or below ``c``."""
    before = positions[positions > 0] - 1
    char = text[before]
    before = before[char > c] if up else before[char < c]
    char = text[before]
    order = np.argsort(char, kind="stable")
    before, char = before[order], char[order]
    edges = np.flatnonzero(np.diff(char)) + 1
    for part in np.split(before, edges):
        if len(part):
            into.setdefault(int(text[part[0]]), []).append(part)


def _joined(parts: list[np.ndarray] | None) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


def _induce(text: np.ndarray, first: np.ndarray, lms: dict[int, np.ndarray], separators: np.ndarray) -> np.ndarray:
    """The suffix array from the LMS positions of each bucket, in order.

    One pass over the buckets upwards places the larger types, one downwards the smaller
    types. A bucket is handled as a whole: what earlier buckets induce in it stands in their
    order already.
    """
    chars = np.unique(text).tolist()
    larger: dict[int, list[np.ndarray]] = {}
    placed: dict[int, np.ndarray] = {}
    for c in chars:
        here = _later(_joined(larger.pop(c, None)), first)
        placed[c] = here
        _deal(text, here, larger, c, up=True)
        if c in lms:
            _deal(text, lms[c], larger, c, up=True)
    smaller: dict[int, list[np.ndarray]] = {}
    out: list[np.ndarray] = []
    for c in reversed(chars):
        if c == 0:
            here = np.array([len(text) - 1])
        elif c == 1:
            here = separators[::-1]  # each a character of its own, by position
        else:
            here = _later(_joined(smaller.pop(c, None)), first)
        _deal(text, here, smaller, c, up=False)
        _deal(text, placed[c][::-1], smaller, c, up=False)
        out.append(here)
        out.append(placed[c][::-1])
    return np.concatenate(out)[::-1]


def _order_names(names: np.ndarray) -> np.ndarray:
    """The suffixes of a string of names in order, by doubling what is compared; only suffixes
    that are still tied are looked at again."""
    n = len(names)
    rank = names.astype(np.int64)
    tied, step = np.arange(n), 1
    # Ranks are places in the order, so that a tied group can be refined within its range.
    order = np.argsort(rank, kind="stable")
    starts = np.flatnonzero(np.diff(rank[order], prepend=-1))
    sizes = np.diff(np.append(starts, n))
    rank[order] = np.repeat(starts, sizes)
    tied = order[np.repeat(sizes, sizes) > 1]
    while len(tied):
        follow = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        here = np.lexsort((follow, rank[tied]))
        tied, follow = tied[here], follow[here]
        group = rank[tied]
        new_group = np.diff(group, prepend=-1) != 0
        new_key = new_group | (np.diff(follow, prepend=-2) != 0)
        base = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]
        key_at = np.flatnonzero(new_key)[np.cumsum(new_key) - 1]
        rank[tied] = group + (key_at - base)
        size = np.diff(np.append(np.flatnonzero(new_key), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer string that ends with its only 0; 1 separates parts, each
    separator counting as a character of its own, smaller than all but 0 and earlier ones."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    at = np.arange(n)
    change = np.diff(text.astype(np.int64))
    # Smaller type: the next different character is larger.
    turn = np.where(change != 0, at[:-1], n)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = np.ones(n, dtype=bool)
    small[:-1] = change[np.minimum(turn, n - 2)] > 0
    first = np.where(np.concatenate(([True], change != 0)), at, 0)
    first = np.maximum.accumulate(first)  # start of the run of equal characters
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    separators = np.flatnonzero(text == 1)

    def buckets(positions: np.ndarray) -> dict[int, np.ndarray]:
        char = text[positions]
        order = np.argsort(char, kind="stable")
        positions = positions[order]
        edges = np.flatnonzero(np.diff(char[order])) + 1
        return {int(text[p[0]]): p for p in np.split(positions, edges) if len(p)}

    # Sort LMS substrings by inducing from them in any order, then name them.
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    array = _induce(text, first, buckets(lms), separators)
    ordered = array[is_lms[array]]
    place = np.zeros(n, dtype=np.int64)
    place[lms] = np.arange(len(lms))
    ends = np.append(lms[1:], n - 1)
    length = ends[place[ordered]] - ordered + 1
    same = np.zeros(len(ordered), dtype=bool)
    same[1:] = length[1:] == length[:-1]
    same[1:] &= (text[ordered[1:]] > 1) & (text[ordered[1:] + length[1:] - 1] > 1)
    live, k = np.flatnonzero(same), 0
    while len(live):
        a, b = ordered[live] + k, ordered[live - 1] + k
        equal = text[a] == text[b]
        same[live[~equal]] = False
        live = live[equal & (k + 1 < length[live])]
        k += 1
    name = np.empty(len(lms), dtype=np.int64)
    name[place[ordered]] = np.cumsum(~same) - 1
    if name.max(initial=0) + 1 < len(lms):
        ordered = lms[_order_names(name)]
    return _induce(text, first, buckets(ordered), separators)


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, by text position.

    Only positions whose left neighbours differ are compared; from there the value falls by
    one per position (Kärkkäinen, Manzini and Puglisi, 2009).
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[array[1:]] = array[:-1]
    cut = np.flatnonzero(text <= 1)
    left = cut[np.searchsorted(cut, np.arange(n))] - np.arange(n)  # to the part's end
    prev = np.maximum(before, 1) - 1
    own = np.empty(n, dtype=bool)
    own[0] = True
    own[1:] = (before[1:] <= 0) | (text[:-1] != text[prev[1:]]) | (text[:-1] <= 1)
    at = np.flatnonzero(own & (before >= 0))
    other = before[at]
    most = np.minimum(left[at], left[other])
    value = np.zeros(n, dtype=np.int64)
    data = np.concatenate((np.maximum(text, 2) - 2, np.zeros(8, dtype=text.dtype))).astype(np.uint8)
    packed = np.lib.stride_tricks.as_strided(data, shape=(n, 8), strides=(1, 1))
    live = np.arange(len(at))
    k = 0
    same = np.zeros(len(at), dtype=np.int64)
    while len(live):
        a = packed[at[live] + k].reshape(-1, 8).view(np.uint64).ravel()
        b = packed[other[live] + k].reshape(-1, 8).view(np.uint64).ravel()
        x = a ^ b
        equal = x == 0
        low = x & (~x + _U(1))
        part = np.where(equal, 8, np.log2(np.where(equal, _U(1), low).astype(float)).astype(np.int64) // 8)
        same[live] += part
        go = equal & (k + 8 < most[live])
        live = live[go]
        k += 8
    value[at] = np.minimum(same, most)
    start = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return np.maximum(value[start] - (np.arange(n) - start), 0)


def repeated_windows(
    contexts: list[bytes], windows: list[int], copies: list[int], length: int
) -> list[np.ndarray]:
    """For each context, which of its first ``windows`` positions start a string of ``length``
    bytes that starts at another place too; a context stands for ``copies`` places."""
    if not contexts:
        return []
    sizes = np.array([len(c) for c in contexts])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.ones(int((sizes + 1).sum()), dtype=np.int16)
    raw = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.int16) + 2
    inside = np.ones(len(text), dtype=bool)
    inside[starts + sizes] = False
    text[inside] = raw
    text[-1] = 0
    array = suffix_array(text)
    common = permuted_prefixes(text, array)
    run = np.cumsum(common[array] < length)
    weight = np.zeros(len(text), dtype=np.int64)
    for s, w, c in zip(starts, windows, copies):
        weight[s : s + w] = c
    total = np.bincount(run, weights=weight[array], minlength=run[-1] + 1)
    often = np.zeros(len(text), dtype=bool)
    often[array] = total[run] >= 2
    return [often[s : s + w] for s, w in zip(starts, windows)]


# --- anchors ---------------------------------------------------------------------------


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, from prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    pad = -len(values) % width
    full = np.concatenate((values, np.full(pad, np.iinfo(np.uint64).max, dtype=_U))).reshape(-1, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor in texts that stand one after another.

    ``ends`` are the ends of the texts in ``data``. Returns ``low`` (first window), ``windows``,
    ``anchor`` (position) and ``hash`` of each run; runs do not cross texts.
    """
    empty = {k: np.zeros(0, dtype=np.int64) for k in ("low", "windows", "anchor")}
    empty["hash"] = np.zeros(0, dtype=_U)
    n = len(data)
    if n < length:
        return empty
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=sums[1:])
        hashes = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    keyed = (hashes >> _U(_POSITION_BITS) << _U(_POSITION_BITS)) | np.arange(len(hashes), dtype=_U)
    least = _sliding_least(keyed, length - gram + 1)
    at = (least & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
    end = ends[np.searchsorted(ends, np.arange(len(at)), side="right")]
    fits = np.flatnonzero(np.arange(len(at)) + length <= end)
    if not len(fits):
        return empty
    first = np.ones(len(fits), dtype=bool)
    first[1:] = (at[fits[1:]] != at[fits[:-1]]) | (np.diff(fits) != 1)
    low = fits[first]
    windows = np.diff(np.append(np.flatnonzero(first), len(fits)))
    return {"low": low, "windows": windows, "anchor": at[low], "hash": hashes[at[low]]}


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of ``length`` bytes or more put together into pieces of about ``PIECE`` bytes: bytes,
    their ends, the number of each text, and where in it the part starts."""
    parts, owner, start, held = [], [], [], 0
    for i, text in enumerate(texts):
        for s in range(0, max(0, len(text) - length + 1), PIECE):
            part = text[s : s + PIECE + length - 1]
            if held and held + len(part) > PIECE:
                yield _together(parts, owner, start)
                parts, owner, start, held = [], [], [], 0
            parts.append(part)
            owner.append(i)
            start.append(s)
            held += len(part)
    if parts:
        yield _together(parts, owner, start)


def _together(parts: list[bytes], owner: list[int], start: list[int]):
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return data, np.cumsum([len(p) for p in parts]), np.array(owner), np.array(start)


def _runs(texts: list[bytes], length: int, gram: int) -> Iterator[pd.DataFrame]:
    """Contexts of texts: ``text`` (number), ``fp``, ``ctx`` (hash), ``low``, ``windows``,
    ``offset`` (of the anchor in the context), ``bytes``."""
    import xxhash

    for data, ends, owner, start in _pieces(texts, length):
        found = anchors(data, ends, length, gram)
        if not len(found["low"]):
            continue
        which = np.searchsorted(ends, found["low"], side="right")
        begin = np.concatenate(([0], ends[:-1]))[which]
        raw = data.tobytes()
        low, windows = found["low"], found["windows"]
        cut = [raw[a : a + w + length - 1] for a, w in zip(low.tolist(), windows.tolist())]
        offset = (found["anchor"] - low).tolist()
        ctx = [xxhash.xxh3_64_intdigest(c, seed=o) for c, o in zip(cut, offset)]
        yield pd.DataFrame(
            {
                "text": owner[which],
                "fp": found["hash"].view(np.int64),
                "ctx": np.array(ctx, dtype=_U).view(np.int64),
                "low": low - begin + start[which],
                "windows": windows,
                "offset": offset,
                "bytes": cut,
            }
        )


def _encoded(column: pd.Series) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "replace") for t in column]


def _place(key: np.ndarray, low: np.ndarray) -> np.ndarray:
    """A hash of (text, position), the same wherever it is computed."""
    with np.errstate(over="ignore"):
        return mix(mix(key.astype(np.int64).view(_U)) + low.astype(np.int64).view(_U)).view(np.int64)


def _occurrences(length: int, gram: int):
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = batch["key"].to_numpy()
            for at in range(0, len(batch), 512):
                texts = _encoded(batch["text"].iloc[at : at + 512])
                for runs in _runs(texts, length, gram):
                    mine = key[at + runs["text"].to_numpy()]
                    yield pd.DataFrame(
                        {
                            "key": mine,
                            "low": runs["low"],
                            "windows": runs["windows"],
                            "fp": runs["fp"],
                            "ctx": runs["ctx"],
                        }
                    )

    return found


def _fetch(bits, owners, length: int, gram: int):
    """Contexts that stand for their kind, with their bytes."""

    def fetched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[has(owners.value, batch["key"].to_numpy())]
            key = batch["key"].to_numpy()
            for at in range(0, len(batch), 256):
                texts = _encoded(batch["text"].iloc[at : at + 256])
                for runs in _runs(texts, length, gram):
                    mine = key[at + runs["text"].to_numpy()]
                    keep = has(bits.value, _place(mine, runs["low"].to_numpy()))
                    yield runs.loc[keep, ["fp", "ctx", "windows", "offset", "bytes"]]

    return fetched


def _ranges(often: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], often, [False])).astype(np.int8)))
    return edge[0::2].tolist(), edge[1::2].tolist()


_SPANS = "fp long, ctx long, lows array<long>, highs array<long>"


def _solve(length: int):
    def solved(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["fp", "ctx"], kind="stable")
        often = repeated_windows(
            shard["bytes"].to_list(), shard["windows"].tolist(), shard["copies"].tolist(), length
        )
        spans = [_ranges(o) for o in often]
        out = pd.DataFrame(
            {
                "fp": shard["fp"].to_numpy(),
                "ctx": shard["ctx"].to_numpy(),
                "lows": [s for s, _ in spans],
                "highs": [e for _, e in spans],
            }
        )
        return out[out["lows"].str.len() > 0]

    return solved


def _cells(length: int, width: int):
    """A context cut into cells: ``cell``, ``near`` (hash of the bytes that all windows of the cell
    hold), ``part`` (128-bit hash of the context's own windows in it), ``at`` (the first of these)
    and ``windows``."""
    import xxhash

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for fp, ctx, n, offset, raw, copies in zip(
                *(batch[c] for c in ("fp", "ctx", "windows", "offset", "bytes", "copies"))
            ):
                least = offset - n + 1  # bytes before the anchor in the last window
                for cell in range(least // width, offset // width + 1):
                    low, high = cell * width, (cell + 1) * width - 1
                    first, last = max(low, least), min(high, offset)
                    shared = raw[offset - low : max(offset - high + length, 0)]
                    own = raw[offset - last : offset - first + length]
                    near = xxhash.xxh3_64_intdigest(shared, seed=cell)
                    part = xxhash.xxh3_128_digest(own, seed=first)
                    rows.append((fp, ctx, cell, near, part, offset - last, last - first + 1, copies))
            found = pd.DataFrame(
                rows, columns=["fp", "ctx", "cell", "near", "part", "at", "windows", "copies"]
            )
            found["near"] = found["near"].to_numpy(dtype=_U).view(np.int64)
            yield found

    return cut


def _shards(contexts: DataFrame, length: int, *by: str) -> DataFrame:
    """Repeated windows of contexts; those that agree in ``by`` meet in a shard."""
    total = contexts.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    return contexts.groupBy(F.pmod(F.xxhash64(*by), F.lit(shards)).alias("shard")).applyInPandas(
        _solve(length), _SPANS
    )


def _in_cells(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the contexts of anchors that have too many of them for a shard."""
    schema = "fp long, ctx long, cell int, near long, part binary, at long, windows long, copies long"
    entries = materialise(contexts.mapInPandas(_cells(length, CELL), schema))
    group, kind = ["fp", "cell", "near"], ["fp", "cell", "near", "part"]
    kinds = materialise(
        entries.groupBy(*kind)
        .agg(F.sum("copies").alias("copies"), F.min(F.struct("ctx", "at", "windows")).alias("rep"))
        .withColumn("id", F.monotonically_increasing_id())
    )
    sizes = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    sizes = materialise(sizes)
    alone = (
        kinds.join(sizes, group, "left_anti")
        .filter("copies > 1")
        .select(
            "fp",
            F.col("id").alias("ctx"),
            F.array(F.lit(0).cast("long")).alias("lows"),
            F.array("rep.windows").alias("highs"),
        )
    )
    mixed = kinds.join(sizes, group).select(
        *group, "id", "copies", "kinds", F.col("rep.ctx").alias("ctx"), "rep.at", "rep.windows"
    )
    own = F.substring("bytes", F.col("at").cast("int") + 1, (F.col("windows") + (length - 1)).cast("int"))
    parts = materialise(
        mixed.join(contexts.select("fp", "ctx", "bytes"), ["fp", "ctx"]).select(
            *group, F.col("id").alias("ctx"), "windows", "copies", "kinds", own.alias("bytes")
        )
    )
    solved = _shards(parts.filter(F.col("kinds") <= ANCHOR_CONTEXTS), length, *group)
    counted = _one_by_one(parts.filter(F.col("kinds") > ANCHOR_CONTEXTS), length)
    spans = materialise(solved.unionByName(counted).unionByName(alone))
    found = spans.withColumnRenamed("ctx", "id").drop("fp").join(kinds.select("id", *kind), "id")
    return (
        entries.join(found, kind)
        .select(
            "fp",
            "ctx",
            F.transform("lows", lambda p: p + F.col("at")).alias("lows"),
            F.transform("highs", lambda p: p + F.col("at")).alias("highs"),
        )
        .groupBy("fp", "ctx")
        .agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"))
    )


def _one_by_one(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated windows of contexts, each window counted by itself."""
    single = materialise(
        contexts.mapInPandas(_windows(length), "fp long, ctx long, at long, mark binary, copies long")
    )
    twice = materialise(
        single.groupBy("mark").agg(F.sum("copies").alias("places")).filter("places > 1").select("mark")
    )
    return (
        single.join(twice, "mark", "left_semi")
        .groupBy("fp", "ctx")
        .agg(F.sort_array(F.collect_list("at")).alias("lows"))
        .withColumn("highs", F.transform("lows", lambda p: p + 1))
    )


def _windows(length: int):
    """Each window of a context by itself, as a 128-bit hash."""
    import xxhash

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fp, ctx, n, raw, copies in zip(
                batch["fp"], batch["ctx"], batch["windows"], batch["bytes"], batch["copies"]
            ):
                mark = [xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(n)]
                yield pd.DataFrame(
                    {"fp": fp, "ctx": ctx, "at": range(n), "mark": mark, "copies": copies}
                )

    return single


def _cut_out(length: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_bytes, removed, spans, sha = [], [], [], []
            for text, lows, highs in zip(_encoded(batch["text"]), batch["lows"], batch["highs"]):
                n_bytes.append(len(text))
                gone = 0
                count = 0
                digest = hashlib.sha256()
                at = 0
                if lows is not None and len(lows):
                    order = np.argsort(np.asarray(lows), kind="stable")
                    low = np.asarray(lows, dtype=np.int64)[order]
                    high = np.maximum.accumulate(np.asarray(highs, dtype=np.int64)[order])
                    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
                    stop = high[np.append(new[1:] - 1, len(high) - 1)]
                    for a, b in zip(low[new].tolist(), stop.tolist()):
                        digest.update(text[at:a])
                        gone += b - a
                        count += 1
                        at = b
                digest.update(text[at:])
                removed.append(gone)
                spans.append(count)
                sha.append(digest.hexdigest())
            yield pd.DataFrame(
                {
                    "id": batch["id"].to_numpy(),
                    "n_bytes": n_bytes,
                    "n_removed": removed,
                    "n_spans": spans,
                    "kept_sha256": sha,
                }
            )

    return cut


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Spans to remove: ``key``, ``low``, ``high`` (bytes, end excluded), possibly overlapping.

    ``texts`` has ``key`` (long; equal texts of one id share it) and ``text``.
    """
    spark = texts.sparkSession
    context = spark.sparkContext
    found = materialise(
        texts.mapInPandas(_occurrences(length, gram), "key long, low long, windows long, fp long, ctx long")
    )
    often = found.groupBy("fp").count().filter("count > 1")
    bits = context.broadcast(bitmap(often, "fp"))

    @F.pandas_udf("boolean")
    def repeated(fp: pd.Series) -> pd.Series:
        return pd.Series(has(bits.value, fp.to_numpy()))

    occurrences = materialise(found.filter(repeated("fp")))
    kinds = materialise(
        occurrences.groupBy("fp", "ctx").agg(
            F.count(F.lit(1)).alias("copies"),
            F.max("windows").alias("windows"),
            F.min(F.struct("key", "low")).alias("rep"),
        )
    )
    per_anchor = materialise(
        kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1")
    )
    alone = (
        kinds.join(per_anchor, "fp", "left_anti")
        .filter("copies > 1")
        .select(
            "fp",
            "ctx",
            F.array(F.lit(0).cast("long")).alias("lows"),
            F.array("windows").alias("highs"),
        )
    )
    mixed = materialise(kinds.drop("windows").join(per_anchor, "fp"))

    @F.pandas_udf("long")
    def place(key: pd.Series, low: pd.Series) -> pd.Series:
        return pd.Series(_place(key.to_numpy(), low.to_numpy()))

    chosen = mixed.select("rep.key", "rep.low")
    bits_of = context.broadcast(bitmap(chosen.select(place("key", "low").alias("h")), "h"))
    owners = context.broadcast(bitmap(chosen.select("key"), "key"))
    fetched = texts.mapInPandas(
        _fetch(bits_of, owners, length, gram), "fp long, ctx long, windows long, offset long, bytes binary"
    )
    contexts = materialise(
        fetched.join(mixed.select("fp", "ctx", "copies", "kinds"), ["fp", "ctx"]).dropDuplicates(["fp", "ctx"])
    )
    sorted_out = _shards(contexts.filter(F.col("kinds") <= ANCHOR_CONTEXTS), length, "fp")
    in_cells = _in_cells(contexts.filter(F.col("kinds") > ANCHOR_CONTEXTS), length)
    spans = materialise(sorted_out.unionByName(in_cells).unionByName(alone))
    # A row that is repeated often has its spans once.
    places = occurrences.select("key", "low", "fp", "ctx").distinct()
    return places.join(spans, ["fp", "ctx"]).select(
        "key",
        F.transform("lows", lambda p: p + F.col("low")).alias("lows"),
        F.transform("highs", lambda p: p + F.col("low") + (length - 1)).alias("highs"),
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    gram: int = GRAM,
) -> DataFrame:
    """Each row's text without its repeated strings: ``id``, ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs) and ``kept_sha256``.

    Texts are bytes of UTF-8; null is empty. Strings are judged on the input, also inside one
    text, overlapping ones too. Rows of the same id and text are two places. Null ids are
    allowed. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    slim = docs.select(
        named(id_col).alias("id"),
        F.xxhash64(named(id_col), named(text_col)).alias("key"),
        named(text_col).cast("string").alias("text"),
    )
    spans = materialise(repeated_spans(slim.select("key", "text"), length, gram))
    per_text = materialise(
        spans.groupBy("key").agg(
            F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs")
        )
    )
    bits = spark.sparkContext.broadcast(bitmap(per_text.select("key"), "key"))

    @F.pandas_udf("boolean")
    def touched(key: pd.Series) -> pd.Series:
        return pd.Series(has(bits.value, key.to_numpy()))

    none = F.lit(None).cast("array<long>")
    may = slim.filter(touched("key")).join(per_text, "key", "left")
    rest = slim.filter(~touched("key")).withColumns({"lows": none, "highs": none})
    columns = [F.col("id").cast("string").alias("id"), "text", "lows", "highs"]
    schema = "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = _cut_out(length)
    out = may.select(*columns).mapInPandas(cut, schema).unionByName(rest.select(*columns).mapInPandas(cut, schema))
    return out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")

