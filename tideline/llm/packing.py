"""Packing documents into training sequences of balanced attention cost.

Texts become token ids in the tasks that read them, and each task packs what it reads, group
after group, so nothing is shuffled. In a group the pieces are taken in descending order. The
cost of a piece is linear in its length plus quadratic (attention inside the document); a
piece goes to the sequence of lowest cost that still has room for it. As many sequences are
open as the group fills; a piece that fits nowhere is cut to the room that is left. What
remains of a group is cut into sequences whose lengths are powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.registry import named, query, table

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 1_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Pieces of text whose ids a worker remembers, so that common words are looked up.
KNOWN_PIECES = 1_000_000

Cut = tuple[int, int, int]
Placed = tuple[int, int, int, int, int]


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space other than the space and the line feed, in Python's wide sense.
_RARE_SPACE = re.compile(
    "[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
)


# The pattern of byte-level files; a fixed value.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level file as ranks, if the file's ids are in the order of its
    merges and its pattern is ``PATTERN``; a faster encoder then gives the same ids."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True)
    if not plain or before.get("add_prefix_space") or told.get("normalizer") or model["type"] != "BPE":
        return None
    # Printable bytes stand for themselves, the others for the characters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in told.get("added_tokens", [])}
    vocabulary = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocabulary.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in special}
    return ranks if len(ranks) == 256 + len(merges) else None


class _Known(dict):
    """Ids of the cuts of a text, encoded when they are first met."""

    def __init__(self, path: str):
        super().__init__()
        ranks = _ranks(path)
        if ranks is not None:
            import tiktoken

            core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.ids_of = core.encode_ordinary
        else:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(path)
            whole.encode_special_tokens = True
            self.ids_of = lambda text: whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        ids = self.ids_of(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, cut: str) -> bytes:
        found = self[cut] = self.encode(" " + cut)
        return found


class WordCachedEncoder:
    """Ids of a byte-level BPE file of the ``tokenizers`` library, words remembered.

    The pattern of such a file never joins the two sides of a single space between two other
    characters, so a text is cut before such spaces and each cut is encoded by itself once.
    A text that holds the string of a special token is left to the library, which gives its id.
    """

    def __init__(self, path: str, known: int = KNOWN_PIECES):
        from tokenizers import Tokenizer

        self.known = known
        self.ids = _Known(path)
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    @staticmethod
    def cuts(text: str) -> list[str]:
        """Cuts of ``text``; all but the first had one space before them, which is left out."""
        parts = text.split(" ")
        plain = parts[0] and parts[-1] and "  " not in text and "\n " not in text and " \n" not in text
        if plain and not _RARE_SPACE.search(text):
            return parts
        out = parts[:1]
        for part in parts[1:]:
            # A space beside white space or an end of the text stays inside a cut.
            if not out[-1] or out[-1][-1].isspace() or not part or part[0].isspace():
                out[-1] += " " + part
            else:
                out.append(part)
        return out

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of ``text``."""
        if any(string in text for string in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if len(self.ids) > self.known:
            self.ids.clear()
        parts = self.cuts(text)
        first = self.ids.encode(parts[0])
        return first + b"".join(map(self.ids.__getitem__, parts[1:]))


def _powers(n: int) -> Iterator[int]:
    while n:
        top = 1 << (n.bit_length() - 1)
        yield top
        n -= top


def pack_group(
    lengths: list[int],
    capacity: int = CAPACITY,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> list[Placed]:
    """Pieces of documents of these lengths: (document, start, length, sequence, offset).

    Sequences are full, but for the last of the group, whose lengths are powers of two.
    ``capacity`` is a power of two.
    """
    total = sum(lengths)
    full = total // capacity
    rooms = [capacity] * full + list(_powers(total - full * capacity))
    used = [0] * len(rooms)
    cost = [0.0] * len(rooms)
    placed: list[Placed] = []

    def put(doc: int, start: int, length: int, seq: int) -> None:
        placed.append((doc, start, length, seq, used[seq]))
        used[seq] += length
        cost[seq] += linear * length + quadratic * length * length

    pieces: list[Cut] = []
    free = 0
    for doc, length in enumerate(lengths):
        start = 0
        while length - start >= capacity and free < full:
            put(doc, start, capacity, free)  # fills a sequence by itself
            start, free = start + capacity, free + 1
        if start < length:
            pieces.append((length - start, doc, start))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    costs, room = np.array(cost), np.array(rooms) - np.array(used)
    late: list[Cut] = []
    for length, doc, start in pieces:
        fits = np.where(room >= length, costs, np.inf)
        s = int(fits.argmin()) if len(fits) else 0
        if len(fits) and fits[s] < np.inf:
            put(doc, start, length, s)
            costs[s], room[s] = cost[s], rooms[s] - used[s]
        else:
            late.append((length, doc, start))
    # What fitted nowhere is cut into the rooms that are left, the lowest cost first.
    rest = sorted((cost[s], s) for s in range(len(rooms)) if used[s] < rooms[s])
    at = 0
    for length, doc, start in late:
        while length:
            s = rest[at][1]
            part = min(length, rooms[s] - used[s])
            put(doc, start, part, s)
            start, length = start + part, length - part
            at += used[s] == rooms[s]
    return placed


def _packer(path: str, capacity: int, group_tokens: int, linear: float, quadratic: float):
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        held: list[tuple[object, bytes]] = []
        tokens, sequence = 0, 0

        def group() -> Iterator[pd.DataFrame]:
            nonlocal held, tokens, sequence
            placed = pack_group([len(b) // 4 for _, b in held], capacity, linear, quadratic)
            last = 0
            # A few thousand pieces at a time, as each row carries its ids.
            for k in range(0, len(placed), 2000):
                rows = placed[k : k + 2000]
                ids = [held[d][1][4 * a : 4 * (a + n)] for d, a, n, _, _ in rows]
                yield pd.DataFrame(
                    {
                        "id": pd.Series([held[d][0] for d, *_ in rows], dtype=object),
                        "start": [a for _, a, _, _, _ in rows],
                        "length": [n for _, _, n, _, _ in rows],
                        "ids": ids,
                        "doc_tokens": [len(held[d][1]) // 4 for d, *_ in rows],
                        "local": [sequence + s for *_, s, _ in rows],
                        "offset": [o for *_, o in rows],
                    }
                )
                last = max(last, max(s for *_, s, _ in rows) + 1)
            sequence += last
            held, tokens = [], 0

        for batch in batches:
            texts = batch["text"].tolist()
            keys = batch["id"].tolist()
            for key, text in zip(keys, texts):
                found = encoder.encode(text or "") + end
                held.append((key, found))
                tokens += len(found) // 4
                if tokens >= group_tokens:
                    yield from group()
        if held:
            yield from group()

    return packed


_ENCODERS: dict[str, WordCachedEncoder] = {}


def _encoder(path: str) -> WordCachedEncoder:
    """The encoder of this worker; its remembered words serve the worker's next tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordCachedEncoder(path)
    return _ENCODERS[path]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    capacity: int = CAPACITY,
    group_tokens: int = GROUP_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
) -> DataFrame:
    """Pieces of all documents: ``id``, ``start``, ``length``, ``ids`` (binary, little-endian
    unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``.

    A document's ids end with the id 1; null text is empty and has that id only. Each id lies
    in exactly one piece. Every row is a document of its own, also if its id is null or repeated.
    An empty table gives no rows. Other columns are not read. ``path`` is the tokenizer file.
    A task holds one group of about ``group_tokens`` tokens, or one document if that is longer.
    """
    slim = docs.select(
        named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text")
    )
    schema = "id string, start long, length long, ids binary, doc_tokens long, local long, offset long"
    worker = _packer(path or vocabulary_path(), capacity, group_tokens, linear, quadratic)
    pieces = slim.mapInPandas(worker, schema)
    return pieces.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias("id"),
        "start",
        "length",
        "ids",
        "doc_tokens",
        # The task's number above, the sequence of the task below.
        (F.shiftleft(F.spark_partition_id().cast("long"), 36) + F.col("local")).alias("sequence_id"),
        "offset",
    )


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query("op3_balanced_packing")
def op3_balanced_packing(spark, sf_dir):
    return digest(pack(table(spark, sf_dir, "documents")))

