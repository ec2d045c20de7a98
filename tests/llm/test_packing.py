from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tideline.llm import packing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(packing.vocabulary_path())


def odd_texts():
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "été", "don't", "x9", "!!", " ", " ", "日本", "<|endoftext|>", ".", "'", "👍🏽", "\x1c", "\x85"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)]
    return texts + ["", " ", " a", "a ", "  a  ", "\n a", "a \n b", "one two three " * 50, "\x00first a"]


def test_remembered_words_give_the_tokenizers_ids(tokenizer):
    texts = odd_texts()
    encoder = packing.WordCachedEncoder(packing.vocabulary_path(), known=50)
    for _ in range(2):
        found = [np.frombuffer(encoder.encode(t), dtype="<u4").tolist() for t in texts]
        assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings_have_the_tokenizers_ids(tokenizer):
    special = tokenizer.token_to_id("<|endoftext|>")
    encoder = packing.WordCachedEncoder(packing.vocabulary_path())
    for text in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y"):
        ids = np.frombuffer(encoder.encode(text), dtype="<u4").tolist()
        assert special in ids and ids == tokenizer.encode(text, add_special_tokens=False).ids


def test_groups_fill_their_sequences():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.choice([0, 1, 3, 50, 300, 1000, 2048, 2049, 5000]) for _ in range(rng.randint(0, 60))]
        placed = packing.pack_group(lengths)
        at, parts = defaultdict(list), defaultdict(list)
        for doc, start, length, seq, offset in placed:
            assert length > 0
            parts[doc].append((start, length))
            at[seq].append((offset, length))
        for doc, length in enumerate(lengths):
            end = 0
            for start, n in sorted(parts[doc]):
                assert start == end
                end += n
            assert end == length
        short = 0
        for pieces in at.values():
            end = 0
            for offset, n in sorted(pieces):
                assert offset == end
                end += n
            assert end <= 2048 and end & (end - 1) == 0
            short += end < 2048
        assert short <= 11


def test_costs_are_balanced():
    rng = random.Random(3)
    lengths = [rng.randint(20, 900) for _ in range(900)]
    cost = defaultdict(float)
    for _, _, n, seq, _ in packing.pack_group(lengths):
        cost[seq] += n + n * n / 2048
    full = sorted(cost.values())[11:]
    assert max(full) < 1.35 * sum(full) / len(full)


def test_pieces_hold_every_id_once(spark, tokenizer):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, None), (3, "again"), (2**60 + 1, "far " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.digest(packing.pack(docs, group_tokens=3000)).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])
    parts = defaultdict(list)
    for p in pieces:
        parts[p.doc_id].append(p)
    assert set(parts) == set(want)
    for i, found in parts.items():
        if len(want[i]) == 1:
            ids, end = want[i][0], 0
            for p in sorted(found, key=lambda p: p.start):
                assert p.start == end and p.doc_tokens == len(ids)
                end += p.length
                assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : end], dtype="<u4").tobytes())
            assert end == len(ids)
        assert sum(p.length for p in found) == sum(map(len, want[i]))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for found in sequences.values():
        end = 0
        for offset, n in sorted(found):
            assert offset == end
            end += n
        assert end <= 2048


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
