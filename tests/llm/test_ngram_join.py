from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.brute import components, shingles
from tideline.llm import ngram_join


def near_texts(seed, groups=12, copies=6, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    out = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([1, 2, 3, 8, 12, 25, 60, 200]))
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                at = rng.randrange(len(text))
                if rng.random() < 0.4:
                    text.insert(at, rng.choice(words))
                elif len(text) > 1:
                    del text[at]
            sep = rng.choice([" ", "  ", "\t", "\n"])
            out.append(sep.join(w.upper() if rng.random() < 0.1 else w for w in text))
    return out


@pytest.mark.parametrize("seed, width, num", [(1, 3, 90), (2, 3, 80), (3, 5, 80)])
def test_components_equal_brute_force(spark, seed, width, num):
    texts = near_texts(seed) + ["", None, " \n", "one", "ONE", "one two", "two one"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.similar_components(docs, width=width, num=num).collect()
    where, sizes = components(texts, width, num)
    assert sorted(map(tuple, found)) == [(i, sizes[i], where[i]) for i in range(len(texts))]


def test_many_leaves_and_tasks(spark, monkeypatch):
    """Regions that are cut into many leaves give the same components."""
    monkeypatch.setattr(ngram_join, "LEAF_SHINGLES", 150)
    monkeypatch.setattr(ngram_join, "TASK_SHINGLES", 600)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):  # one group in which many are not linked to the centre
        text = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            text[rng.randrange(60)] = f"x{i}"
        texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = ngram_join.similar_components(docs, width=2, num=80).collect()
    where, sizes = components(texts, 2, 80)
    assert len(set(where)) > 1
    assert sorted(map(tuple, found)) == [(i, sizes[i], where[i]) for i in range(len(texts))]


def test_word_hashes_do_not_depend_on_chunks(monkeypatch):
    text = (" ".join(f"word{i % 37}" for i in range(500)) + "  " + "x" * 300).encode()
    whole = ngram_join.word_hashes(text)
    monkeypatch.setattr(ngram_join, "_CHUNK", 64)
    assert np.array_equal(whole, ngram_join.word_hashes(text))
    assert len(whole) == 501 and len(np.unique(whole)) == 38


def test_word_hashes_tell_patterned_words_apart():
    """Thue-Morse words and their complements, which polynomials modulo 2**64 confuse."""
    words = []
    for bits in (10, 11, 12):
        ones = [bin(i).count("1") & 1 for i in range(1 << bits)]
        words += [bytes(97 + b for b in ones), bytes(98 - b for b in ones)]
    words += [b"ab", b"ba", b"aab", b"aba", b"baa", "\u00e9".encode(), b"\x00", b"\x00\x00"]
    found = ngram_join.word_hashes(b" ".join(words))
    assert len(found) == len(words) == len(np.unique(found))


def test_keep_one_with_clashing_names(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(5, same, "a", "b", 1), (3, same + " end", "c", "d", 2), (9, "", "e", "f", 3), (9, None, "g", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _mark string, _id string, _of int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect() if r.text) == [(3, same + " end", "c", "d", 2)]
    assert kept.count() == 3


def test_keep_one_keeps_the_smallest_id_and_all_without_words(spark):
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(5, same, 1), (3, same + " end", 2), (3, same + " end", 3), (None, same, 4), (8, "other words here now yes", 5), (9, "", 6), (9, "", 7), (10, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == sorted(
        [(3, same + " end"), (8, "other words here now yes"), (9, ""), (9, ""), (10, "")]
    )


def test_nulls_repeats_and_empty(spark):
    text = "a b c d e f g h i j k l m n"
    rows = [(None, text), (4, text), (4, text), (None, "lonely words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in ngram_join.similar_components(docs).collect()}
    n = len(shingles(text))
    assert found == {(None, n, 4), (4, n, 4), (None, 2, None)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_components(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0


def test_signatures_are_dealt_into_pieces():
    sigs = ngram_join.signatures(ngram_join.shingle_set(" ".join(f"w{i}" for i in range(300))), 80, 100)
    pieces = ngram_join._dealt(sigs)
    assert len(pieces) == ngram_join.PIECES and max(map(len, pieces)) < len(sigs) / 2
    assert sorted(np.concatenate(pieces)) == sorted(sigs.view(np.int64))
