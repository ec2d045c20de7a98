"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

``build_index`` cuts the documents into shards as they are read: one map over the texts, no
shuffle. A shard is one row: its document ids in ascending order, their lengths, and for each term
a list of (document gap, term frequency), in bytes of the smallest width, cut into blocks of
``BLOCK`` postings. A block knows its last document and, for each term frequency from 1 to
``LEVELS - 1`` and for the largest, the shortest document that has it. From these the highest score
in the block follows for any corpus size and mean length, so an index stays valid when others are
added to it.

``search`` takes the corpus statistics from the index and goes through the shards of a task one by
one, keeping the best ``k`` of each item. For one item and shard, lists are ordered by their highest
possible contribution (the global bound). Those whose bounds together cannot lift a document into
the heap are non-essential: documents are proposed by the other, essential lists only. A proposed
document is dropped as soon as what it has, the maximum of its block in the next non-essential list
and the bounds of the rest stay below the k-th score; only blocks of the documents that are left
are unpacked. The heaps of all tasks are merged by a window, which cuts to ``k`` in each task before
it shuffles.

Items are taken in blocks of at most ``ITEM_TERMS`` distinct terms (or one item), which bounds what
the driver holds and sends. If all fit in one block, the index is built for their terms only.

Nulls, ties, repeats: a null or empty text has no terms, is not counted and never found; items
without terms give no rows. A null id stays null and orders before the others (an id of -2**63
counts as null). Equal scores are ordered by ascending id. Repeated rows are documents of their
own. Items with one id are one item with the terms of all of them. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table
from tideline.session import materialise

BLOCK = 128
LEVELS = 4
#: A shard ends at so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 16_384, 4_000_000
#: Distinct terms of the items that are searched together.
ITEM_TERMS = 200_000
#: Documents of the first window of a shard; the windows after it double.
FIRST_WINDOW = 256
NO_ID = -(1 << 63)
_NONE = np.iinfo(np.uint32).max

INDEX = (
    "n_docs long, n_terms long, ids binary, lengths binary, terms array<binary>, df array<int>, "
    "widths binary, gaps binary, tfs binary, lasts binary, shortest binary, most binary"
)


def _fold() -> bytes:
    """Bytes of terms as they are, A-Z lower-cased, all else a space."""
    out = bytearray(b" " * 256)
    for first, last in (b"09", b"az"):
        out[first : last + 1] = bytes(range(first, last + 1))
    out[ord("A") : ord("Z") + 1] = bytes(range(ord("a"), ord("z") + 1))
    out[128:] = bytes(range(128, 256))
    return bytes(out)


_FOLD = _fold()


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


def _packed(values: np.ndarray) -> tuple[int, bytes]:
    width = next(w for w in (1, 2, 4) if not len(values) or values.max() < 1 << (8 * w))
    return width, values.astype(f"<u{width}").tobytes()


class _Builder:
    """Postings of the documents of one shard."""

    def __init__(self, vocabulary: frozenset[bytes] | None):
        self.vocabulary = vocabulary
        self._clear()

    def _clear(self) -> None:
        self.names: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.lengths: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []
        self.per_doc: list[int] = []
        self.n_docs = self.n_terms = 0

    def add(self, key: int | None, text: str | None) -> None:
        words = terms_of(text)
        if not words:
            return
        self.n_docs += 1
        self.n_terms += len(words)
        counts = Counter(words)
        found = counts.keys() if self.vocabulary is None else counts.keys() & self.vocabulary
        if found:
            names = self.names
            self.ids.append(NO_ID if key is None else key)
            self.lengths.append(len(words))
            self.per_doc.append(len(found))
            self.term += [names.setdefault(t, len(names)) for t in found]
            self.tf += [counts[t] for t in found]

    def full(self) -> bool:
        return self.n_docs >= SHARD_DOCS or len(self.term) >= SHARD_POSTINGS

    def shard(self) -> tuple | None:
        """The row of the documents so far, which are then forgotten."""
        if not self.n_docs:
            return None
        ids = np.array(self.ids, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        # Terms in byte order, so that equal shards are equal rows.
        names = sorted(self.names)
        rank = np.empty(len(names), dtype=np.int64)
        rank[[self.names[t] for t in names]] = np.arange(len(names))
        term = rank[np.array(self.term, dtype=np.int64)] if names else np.zeros(0, dtype=np.int64)
        doc = np.repeat(place, np.array(self.per_doc, dtype=np.int64))
        by_list = np.lexsort((doc, term))
        term, doc = term[by_list], doc[by_list]
        tf = np.array(self.tf, dtype=np.int64)[by_list]
        df = np.bincount(term, minlength=len(names))
        widths, gaps, tfs, lasts, shortest, most = [], [], [], [], [], []
        at = 0
        for n in df.tolist():
            docs, freq = doc[at : at + n], tf[at : at + n]
            at += n
            for values, out in ((np.diff(docs, prepend=-1), gaps), (freq, tfs)):
                width, data = _packed(values)
                widths.append(width)
                out.append(data)
            cuts = np.arange(0, n, BLOCK)
            lasts.append(docs[np.append(cuts[1:], n) - 1])
            most.append(np.maximum.reduceat(freq, cuts))
            level = np.minimum(freq, LEVELS) - 1
            shortest.append(
                np.stack([np.minimum.reduceat(np.where(level == v, lengths[docs], _NONE), cuts) for v in range(LEVELS)], 1)
            )
        joined = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *(p.ravel() for p in parts)]).astype("<u4").tobytes()
        row = (
            self.n_docs, self.n_terms, ids[order].astype("<i8").tobytes(), lengths.astype("<i8").tobytes(),
            names, df.astype(np.int32), bytes(widths), b"".join(gaps), b"".join(tfs),
            joined(lasts), joined(shortest), joined(most),
        )
        self._clear()
        return row


_ARROW = pa.schema(
    [("n_docs", pa.int64()), ("n_terms", pa.int64()), ("ids", pa.binary()), ("lengths", pa.binary()),
     ("terms", pa.list_(pa.binary())), ("df", pa.list_(pa.int32())), ("widths", pa.binary()), ("gaps", pa.binary()),
     ("tfs", pa.binary()), ("lasts", pa.binary()), ("shortest", pa.binary()), ("most", pa.binary())]
)


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Iterable[bytes] | None = None
) -> DataFrame:
    """The shards of ``docs``: postings of ``terms`` only, if given, lengths and totals of all."""
    vocabulary = None if terms is None else frozenset(terms)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(vocabulary)
        row = lambda values: pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, values))], _ARROW)
        for batch in batches:
            for key, text in zip(batch.column("id"), batch.column("text")):
                builder.add(key.as_py(), text.as_py())
                if builder.full():
                    yield row(builder.shard())
        if last := builder.shard():
            yield row(last)

    rows = docs.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text"))
    return rows.mapInArrow(shards, INDEX)


@dataclass(frozen=True)
class Item:
    """A query: its id and its distinct terms."""

    id: int | None
    terms: tuple[bytes, ...]


@dataclass(frozen=True)
class Statistics:
    """Documents, terms with repeats, and documents by term."""

    n_docs: int
    n_terms: int
    df: dict[bytes, int]

    def weight(self, term: bytes) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * self.df[term] + 1)))

    def lengthened(self, lengths: np.ndarray) -> np.ndarray:
        return 100 - 50 + (50 * lengths * self.n_docs) // self.n_terms


def _share(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the weight is multiplied by: grows with the frequency, falls with the length."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _List:
    """One term's postings in a shard; blocks are unpacked when they are needed."""

    def __init__(self, shard: Shard, n: int, gaps: np.ndarray, tfs: np.ndarray, lasts: np.ndarray, top: np.ndarray):
        self.shard, self.n, self.gaps, self.tfs, self.lasts, self.top = shard, n, gaps, tfs, lasts, top
        self.bound = int(top.max())
        # A packed block shows its last document everywhere, so the whole stays in order.
        self.docs = np.repeat(lasts, BLOCK)[:n]
        self.docs[-1] = lasts[-1]
        self.shares = np.zeros(n, dtype=np.int64)
        self.open = np.zeros(len(lasts), dtype=bool)

    def unpack(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        self.open[blocks] = True
        self.shard.unpacked += len(blocks)
        start = blocks * BLOCK
        sizes = np.minimum(start + BLOCK, self.n) - start
        first = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) + np.repeat(start - first, sizes)
        total = np.cumsum(self.gaps[at].astype(np.int64))
        before = np.where(blocks > 0, self.lasts[blocks - 1], -1)
        carried = total[first] - self.gaps[start] - before
        docs = total - np.repeat(carried, sizes)
        self.docs[at] = docs
        self.shares[at] = _share(self.tfs[at].astype(np.int64), self.shard.m[docs])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` up to ``high`` and their shares."""
        first = int(np.searchsorted(self.lasts, low))
        last = min(int(np.searchsorted(self.lasts, high - 1)), len(self.lasts) - 1)
        if first > last:
            return self.docs[:0], self.shares[:0]
        self.unpack(np.arange(first, last + 1))
        cut = slice(*np.searchsorted(self.docs, [low, high]))
        return self.docs[cut], self.shares[cut]


class Shard:
    """An index row made ready for one set of statistics."""

    def __init__(self, row: dict, statistics: Statistics):
        read = lambda name, kind: np.frombuffer(row[name], dtype=kind)
        self.ids = read("ids", "<i8")
        self.m = statistics.lengthened(read("lengths", "<i8"))
        self.unpacked = 0
        df = np.array(row["df"], dtype=np.int64)
        widths = read("widths", np.uint8).reshape(-1, 2).astype(np.int64)
        ends = np.cumsum(widths * df[:, None], axis=0)
        blocks = np.cumsum(-(-df // BLOCK))
        lasts = read("lasts", "<u4").astype(np.int64)
        shortest = read("shortest", "<u4").astype(np.int64).reshape(-1, LEVELS)
        tf = np.minimum(np.arange(1, LEVELS + 1)[None, :], LEVELS).repeat(len(lasts), 0)
        tf[:, -1] = read("most", "<u4")
        top = np.where(shortest == _NONE, 0, _share(tf, statistics.lengthened(shortest))).max(axis=1)
        self.places = {t: i for i, t in enumerate(row["terms"])}
        self._parts = row, df, widths, ends, blocks, lasts, top
        self._lists: dict[bytes, _List] = {}

    @property
    def blocks(self) -> int:
        return len(self._parts[5])

    def list(self, term: bytes) -> _List | None:
        if term not in self.places:
            return None
        if term not in self._lists:
            row, df, widths, ends, blocks, lasts, top = self._parts
            i, n = self.places[term], int(df[self.places[term]])
            cut = slice(int(blocks[i - 1]) if i else 0, int(blocks[i]))
            found = [
                np.frombuffer(row[name], f"<u{widths[i, j]}", n, int(ends[i - 1, j]) if i else 0)
                for j, name in enumerate(("gaps", "tfs"))
            ]
            self._lists[term] = _List(self, n, *found, lasts[cut], top[cut])
        return self._lists[term]


class Heap:
    """The best ``k`` of one item so far, by falling score and then by ascending id."""

    def __init__(self, k: int):
        self.k = k
        self.scores = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)

    @property
    def need(self) -> int:
        """The least score that can still matter; equal ones can, as their ids may be smaller."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.append(self.scores, scores), np.append(self.ids, ids)
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]


def search_shard(shard: Shard, terms: Iterable[bytes], weights: dict[bytes, int], heap: Heap) -> None:
    """Offer the shard's documents that can still be among the best to ``heap``."""
    lists = [(weights[t], found) for t in terms if weights.get(t, 0) > 0 and (found := shard.list(t))]
    lists.sort(key=lambda x: x[0] * x[1].bound)
    bounds = np.cumsum([w * x.bound for w, x in lists])
    low, size = 0, FIRST_WINDOW
    while low < len(shard.ids):
        high, need = min(low + size, len(shard.ids)), heap.need
        first = int(np.searchsorted(bounds, need))  # the lists before it cannot reach need
        if first == len(lists):
            return
        total = np.zeros(high - low, dtype=np.int64)
        for w, x in lists[first:]:
            docs, shares = x.between(low, high)
            total[docs - low] += w * shares
        docs = np.flatnonzero(total)
        have = total[docs]
        docs = docs + low
        for i in range(first - 1, -1, -1):
            w, x = lists[i]
            maybe = have + bounds[i] >= need
            docs, have = docs[maybe], have[maybe]
            if not len(docs):
                break
            block = np.searchsorted(x.lasts, docs)
            beyond = block == len(x.lasts)
            block[beyond] = 0
            top = np.where(beyond, 0, w * x.top[block])
            maybe = have + top + (bounds[i - 1] if i else 0) >= need
            docs, have, block, beyond = docs[maybe], have[maybe], block[maybe], beyond[maybe]
            x.unpack(np.unique(block[~beyond]))
            place = np.minimum(np.searchsorted(x.docs, docs), x.n - 1)
            hit = ~beyond & (x.docs[place] == docs)
            have = have + np.where(hit, w * x.shares[place], 0)
        reach = have >= need
        if reach.any():
            heap.offer(have[reach], shard.ids[docs[reach]])
        low, size = high, 2 * size


def _item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """Items in blocks of bounded distinct terms; rows of one id are one item."""
    rows = items.select(named(id_col).cast("long").alias("id"), named(text_col).alias("text")).orderBy("id")
    block: list[Item] = []
    seen: set[bytes] = set()
    current: tuple[int | None, set[bytes]] | None = None

    def ended(item: tuple[int | None, set[bytes]]) -> Iterator[list[Item]]:
        nonlocal block, seen
        if block and len(seen | item[1]) > ITEM_TERMS:
            yield block
            block, seen = [], set()
        if item[1]:
            block.append(Item(item[0], tuple(sorted(item[1]))))
            seen |= item[1]

    for row in rows.toLocalIterator():
        if current is not None and current[0] == row["id"]:
            current[1].update(terms_of(row["text"]))
            continue
        if current is not None:
            yield from ended(current)
        current = (row["id"], set(terms_of(row["text"])))
    if current is not None:
        yield from ended(current)
    if block:
        yield block


def statistics(index: DataFrame, terms: Iterable[bytes]) -> Statistics:
    """Totals of an index, and in how many documents each of ``terms`` stands."""
    spark = index.sparkSession
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    wanted = spark.createDataFrame([(t,) for t in sorted(terms)], "term binary")
    pairs = index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "df")))
    counts = pairs.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    df = {bytes(r["term"]): r["df"] for r in counts.collect()}
    return Statistics(totals[0] or 0, totals[1] or 0, df)


def search(index: DataFrame, items: list[Item], k: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``: the best ``k`` of each item in each task."""
    found = statistics(index, {t for item in items for t in item.terms})
    weights = {t: found.weight(t) for t in found.df}

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in items]
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({name: batch.column(name)[i].as_py() for name in batch.schema.names}, found)
                for item, heap in zip(items, heaps):
                    search_shard(shard, item.terms, weights, heap)
        for item, heap in zip(items, heaps):
            if len(heap.ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([item.id] * len(heap.ids), pa.int64()),
                        pa.array(heap.ids, pa.int64(), mask=heap.ids == NO_ID),
                        pa.array(heap.scores, pa.int64()),
                    ],
                    ["item_id", "doc_id", "score"],
                )

    return index.mapInArrow(searched, "item_id long, doc_id long, score long")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best documents of each item."""
    blocks = _item_blocks(items, item_id, item_text)
    first, second = next(blocks, None), next(blocks, None)
    heaps = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    if first is not None:
        terms = {t for item in first for t in item.terms} if second is None else None
        index = materialise(build_index(docs, doc_id, doc_text, terms))
        heaps = materialise(search(index, first, k))
        while second is not None:
            heaps = heaps.unionByName(materialise(search(index, second, k)))
            second = next(blocks, None)
    best = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM documents
), counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, totals GROUP BY term, n_docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWERED}, '{_TERM}')) AS term FROM benchmark
), lengthened AS (
  SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms) AS m FROM sizes, totals
), scored AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN lengthened USING (doc_id)
  GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
    doc_id, score
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op12_lexical_search", SQL)
def op12_lexical_search(spark, sf_dir):
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
