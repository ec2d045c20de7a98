from __future__ import annotations

import random
import zlib

import numpy as np

from tideline.llm import quality


def documents(n=1500, seed=1):
    rng = random.Random(seed)
    syllables = "an the ing er tion re st ou le ha wh ed".split()
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.85
        text = " ".join(words) if good else rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w for w in words[:4] for _ in range(12))])
        rows.append((i, text))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return rows, labels


def frames(spark, rows, labels):
    return (
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_held_out_labels_are_predicted(spark):
    rows, labels = documents()
    docs, marks = frames(spark, rows, labels)
    model = quality.train(docs, marks)
    scores = {int(r.id): r.score for r in quality.score(docs, model).collect()}
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores.values())
    held = [(scores[i] >= 0.5, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum(p == bool(y) for p, y in held) / len(held)
    assert right > 0.95


def test_held_out_labels_are_not_read(spark):
    rows, labels = documents(200, 2)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    one = quality.train(*frames(spark, rows, labels))
    two = quality.train(*frames(spark, rows, turned))
    assert np.allclose(one.weights, two.weights) and one.prior == two.prior


def test_risk_turns_back_below_zero():
    """With a prior that is too high the negative part of the risk is kept from falling."""
    rng = np.random.default_rng(1)
    positives = rng.normal(1, 1, (50, quality.FEATURES))
    web = np.vstack([rng.normal(1, 1, (40, quality.FEATURES)), rng.normal(-1, 1, (10, quality.FEATURES))])
    model = quality.fit_nnpu(positives, web, 0.8, decay=0.0)
    g = np.clip(np.log(model.score(web) / (1 - model.score(web))), -30, 30)
    p = np.clip(np.log(model.score(positives) / (1 - model.score(positives))), -30, 30)
    assert np.logaddexp(0, g).mean() - 0.8 * np.logaddexp(0, p).mean() > -0.5


def test_nulls_empties_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (1, "x"), (1, "x")], "doc_id long, text string")
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert len(quality.score(docs, model).collect()) == 4
    assert quality.keep_good(docs, none).count() == 4  # without labels the prior is 1/2
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, none)).count() == 0


def test_whole_text_counts_also_in_pieces():
    text = "ab| " * 300_000
    long, short = quality.describe(text), quality.describe("ab| " * 1000)
    assert np.allclose(long[:256], short[:256], atol=0.02)
    assert not quality.describe(None).any()
