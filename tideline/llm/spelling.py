"""Spelling variants grouped by pivotal grams (Deng, Li and Feng, 2014) for one edit.

Bigrams are ordered by rarity among all words. A word's prefix is its bigrams up to the third
rarest, ties included; its pivots are two of them that do not overlap, chosen by dynamic
programming so that their frequencies add up to the least. One edit spoils at most one pivot. Of two
words one edit apart, let the first be the one whose prefix ends earlier in the order: its
unspoilt pivot is in the prefix of the second. So pivots are the index and prefixes the probes,
both ways round, and no pair is lost.

The position limit is used to the full. An unspoilt pivot has the edit behind it or before it,
so all up to the pivot's end is equal (counted from the front) or all from its start on (counted
from the back). That equal part is the key, not the bigram alone. Where it is shorter than
``FIXED`` code points, a common beginning would bring too many words together; then the other
part, which holds the edit, is halved, and one of its halves is equal too and joins the key.
Candidates that meet at a key are verified by the edit distance.

The bigram table is broadcast: bigrams are pairs of the letters that words consist of, so it has
at most 90 * 90 entries whatever the input. Words, keys and links are tables spread by hash: their
joins are merges by hint, as Spark takes all keys of a word for no more bytes than the written word
and would send millions of them through the driver. Forms are followed to their roots by doubling:
each step at least doubles the count of occurrences, so there are no circles and few rounds.

Nulls: null texts have no words; a null id is spelt as the empty text. Repeated rows are documents
of their own. Empty tables give no rows. Other columns are not read. Ties for a form go to the
smallest word in the order of code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table
from tideline.session import materialise

MIN_LENGTH, MIN_COUNT, TIMES = 5, 3, 2
#: Every how many hashes of (document, run) a code point is deleted.
SLIP = 97
#: Code points of an equal part that is a key by itself.
FIXED = 7
#: Words that a task counts before it hands their counts on.
TASK_WORDS = 400_000

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """A-Z lower-cased, all else as it is."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def slipped(key: str, run: str) -> str:
    """``run`` without a code point where the checksum of document and run says so."""
    mark = zlib.crc32(f"{key}:{run}".encode())
    if mark % SLIP:
        return run
    at = mark % len(run)
    return run[:at] + run[at + 1 :]


def runs_of(text: str | None, key: str) -> Iterator[tuple[str, int]]:
    """The words of one document with their number."""
    counts: Counter[str] = Counter()
    for run, n in Counter(_RUN.findall(text or "")).items():
        counts[lowered(run)] += n
    for run, n in counts.items():
        word = slipped(key, run)
        if len(word) >= MIN_LENGTH:
            yield word, n


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def handed_on() -> pa.RecordBatch:
        words, n = list(total), list(total.values())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

    total: dict[str, int] = {}
    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            for word, n in runs_of(text.as_py(), key):
                total[word] = total.get(word, 0) + n
            if len(total) >= TASK_WORDS:
                yield handed_on()
                total.clear()
    if total:
        yield handed_on()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: words with at least ``MIN_COUNT`` occurrences over all documents."""
    key = F.coalesce(named(id_col).cast("string"), F.lit("")).alias("key")
    partial = docs.select(key, named(text_col).alias("text")).mapInArrow(_word_counts, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


def _grams(words: Iterator[str]) -> Counter[str]:
    counts: Counter[str] = Counter()
    for word in words:
        counts.update({word[i : i + 2] for i in range(len(word) - 1)})
    return counts


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many words each bigram stands; a table bounded by the pairs of letters."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            total.update(_grams(batch.column("word").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"]
        )

    partial = words.select("word").mapInArrow(counted, "gram string, n long")
    return {r["gram"]: r["n"] for r in partial.groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def prefix(word: str, frequency: dict[str, int]) -> list[tuple[int, int]]:
    """(position, frequency) of the bigrams up to the third rarest, in order of position."""
    grams = sorted((frequency[g], g, i) for i in range(len(word) - 1) for g in (word[i : i + 2],))
    last = grams[2][:2]
    return sorted((i, n) for n, g, i in grams if (n, g) <= last)


def pivots(grams: list[tuple[int, int]]) -> tuple[int, int]:
    """Positions of the two bigrams of a prefix that do not overlap and are rarest together.

    ``best[j]`` is the rarest single choice among the bigrams that end before bigram j starts.
    """
    chosen, least, best, done = (0, 0), None, None, 0
    for at, n in grams:
        while done < len(grams) and grams[done][0] + 2 <= at:
            if best is None or grams[done][1] < best[1]:
                best = grams[done]
            done += 1
        if best is not None and (least is None or best[1] + n < least):
            chosen, least = (best[0], at), best[1] + n
    return chosen


def _parts(equal: str, other: str, side: str, index: bool) -> Iterator[str]:
    """Keys of an equal part with the edit in ``other``.

    The indexed word halves its own other part; a probe's may be one longer or shorter, so the
    halves of all three lengths are tried.
    """
    if len(equal) >= FIXED:
        yield f"{side}{equal}"
        return
    m = len(other)
    lengths = (m,) if index else (m - 1, m, m + 1)
    for tail in {n // 2 for n in lengths if n >= 0}:
        if tail <= m:
            yield f"{side}{equal}\0t{other[m - tail :]}"
    for head in {n - n // 2 for n in lengths if n >= 0}:
        if head <= m:
            yield f"{side}{equal}\0h{other[:head]}"


def keys(word: str, places: list[int] | tuple[int, ...], index: bool) -> set[int]:
    """64-bit keys of a word by the bigrams at ``places``."""
    found: set[str] = set()
    for at in places:
        found.update(_parts(word[: at + 2], word[at + 2 :], "f", index))
        found.update(_parts(word[at:], word[:at], "b", index))
    return {xxhash.xxh3_64_intdigest(key.encode()) - (1 << 63) for key in found}


def _keyed(frequency: dict[str, int], index: bool):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            out: list[int] = []
            for i, word in enumerate(batch.column("word").to_pylist()):
                grams = prefix(word, frequency)
                found = keys(word, pivots(grams) if index else [p for p, _ in grams], index)
                at += [i] * len(found)
                out += found
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.int64()), batch.column("word").take(rows), batch.column("n").take(rows)],
                ["key", "word", "n"],
            )

    return keyed


def near_words(words: DataFrame) -> DataFrame:
    """``a``, ``n_a``, ``b``, ``n_b``: each unordered pair of words (``word``, ``n``) that differ by
    exactly one inserted, deleted or replaced code point, once."""
    frequency = gram_counts(words)
    schema = "key long, word string, n long"
    index = words.select("word", "n").mapInArrow(_keyed(frequency, True), schema)
    probe = words.select("word", "n").mapInArrow(_keyed(frequency, False), schema)
    index = index.select("key", F.col("word").alias("v"), F.col("n").alias("n_v"))
    pairs = probe.join(index.hint("merge"), "key").filter(
        (F.col("word") != F.col("v"))
        & (F.abs(F.length("word") - F.length("v")) <= 1)
        & (F.levenshtein("word", "v", 1) == 1)
    )
    swap = F.col("word") > F.col("v")
    either = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return pairs.select(
        either("word", "v").alias("a"), either("n", "n_v").alias("n_a"),
        either("v", "word").alias("b"), either("n_v", "n").alias("n_b"),
    ).distinct()


def with_forms(words: DataFrame, links: DataFrame) -> DataFrame:
    """Each word with its number of near words, and its form and the form's number, if any."""
    ends = [
        F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(f"n_{y}").alias("n"))
        for x, y in (("a", "b"), ("b", "a"))
    ]
    rows = links.select(F.inline(F.array(*ends)))
    # The least of (-n, word) is the near word of largest n, ties to the smallest word.
    best = rows.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), "b")).alias("best")
    )
    common = -F.col("best.minus") >= TIMES * F.col("n")
    return words.join(best.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(common, F.col("best.b")).alias("form"),
        F.when(common, -F.col("best.minus")).alias("form_n"),
    )


def with_roots(found: DataFrame) -> DataFrame:
    """Add ``root``: the word that following forms ends at, by doubling."""
    ahead = materialise(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = ahead.join(step.hint("merge"), "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        farther = materialise(farther)
        ahead = farther.drop("moved")
        if farther.filter("moved").isEmpty():
            break
    return found.join(ahead.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root`` of every word."""
    words = materialise(count_words(docs, id_col, text_col))
    links = near_words(words)
    return with_roots(materialise(with_forms(words, links)))


@query("op11_spelling_variants")
def op11_spelling_variants(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))
