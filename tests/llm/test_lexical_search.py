from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from tideline.llm import lexical_search as search
from tests.llm.brute import lower

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_ranks(docs, items, k):
    """(item, rank, doc, score) of every item; docs are (id, text) rows."""
    counted = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = {}
    for i, text in items:
        asked.setdefault(i, set()).update(TERM.findall(lower(text)))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c, n in counted:
            m, score = 100 - 50 + (50 * n * n_docs) // n_terms, 0
            for t in terms & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, -(10**20) if i is None else i, i, score))
        scores.sort(key=lambda x: x[:2])
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def texts(n, seed, vocabulary=60):
    """Words of very unequal frequency, texts of unequal length, copies."""
    rng = random.Random(seed)
    words = [f"Wört{i}" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    out = []
    for _ in range(n):
        text = " ".join(rng.choices(words, weights, k=rng.choice([1, 5, 20, 200])))
        out.append(rng.choice(out) if out and rng.random() < 0.2 else text)
    return out


def shards_of(docs, size, terms=None):
    builder, rows = search._Builder(terms), []
    for at in range(0, len(docs), size):
        for i, t in docs[at : at + size]:
            builder.add(i, t)
        rows.append(dict(zip(search._ARROW.names, builder.shard())))
    return rows


def searched(docs, items, k, size):
    rows = shards_of(docs, size)
    df = Counter()
    for row in rows:
        df.update(dict(zip(row["terms"], row["df"].tolist())))
    found = search.Statistics(sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows), df)
    weights = {t: found.weight(t) for t in df}
    out, unpacked, blocks = [], 0, 0
    for item, text in items:
        heap = search.Heap(k)
        for row in rows:
            shard = search.Shard(row, found)
            search.search_shard(shard, set(search.terms_of(text)), weights, heap)
            unpacked += shard.unpacked
            blocks += sum(len(found_list.lasts) for found_list in shard._lists.values())
        out += [(item, r, int(i), int(s)) for r, (i, s) in enumerate(zip(heap.ids, heap.scores), 1)]
    return sorted(out, key=str), unpacked, blocks


@pytest.mark.parametrize("block,window,size", [(1, 1, 40), (3, 4, 100), (128, 256, 1000), (5, 2, 7)])
def test_shards_equal_a_plain_program(monkeypatch, block, window, size):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "FIRST_WINDOW", window)
    rng = random.Random(block)
    docs = list(enumerate(texts(150, block)))
    rng.shuffle(docs)
    items = list(enumerate(texts(25, block + 50)))
    for k in (1, 4, 500):
        assert searched(docs, items, k, size)[0] == plain_ranks(docs, items, k)


def test_blocks_are_rejected_before_they_are_unpacked(monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 4)
    monkeypatch.setattr(search, "FIRST_WINDOW", 16)
    rng = random.Random(3)
    docs = [(i, " ".join(["common"] * rng.randint(1, 3) + ["filler"] * rng.randint(0, 9))) for i in range(3000)]
    for i in range(0, 3000, 90):
        docs[i] = (i, docs[i][1] + " rare rare")
    items = [(0, "the rare and common filler")]
    found, unpacked, blocks = searched(docs, items, 3, 3000)
    assert found == plain_ranks(docs, items, 3)
    assert unpacked < blocks / 5


def test_whole_query_with_ties_nulls_and_repeats(spark):
    docs = [*enumerate(texts(80, 9)), (3, "w1 w2"), (3, "w1 w2"), (None, "w1 w2"), (500, None), (501, ""), (502, "--")]
    items = [*enumerate(texts(12, 10)), (2, "w1 w2"), (99, None), (98, "nowhere"), (None, "w1")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(items, "item_id long, text string")
    found = search.rank_documents(frame.selectExpr("*", "1 AS id", "2 AS n_docs"), asked, 6)
    assert sorted(map(tuple, found.collect()), key=str) == plain_ranks(docs, items, 6)


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEM_TERMS", 10)
    docs, items = list(enumerate(texts(60, 11))), list(enumerate(texts(15, 12)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(search._item_blocks(asked, "item_id", "text"))) > 3
    found = search.rank_documents(frame, asked, 5)
    assert sorted(map(tuple, found.collect()), key=str) == plain_ranks(docs, items, 5)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    some = spark.createDataFrame([(1, "w1")], "doc_id long, text string")
    assert search.rank_documents(docs, one).count() == 0
    assert search.rank_documents(some, items).count() == 0
