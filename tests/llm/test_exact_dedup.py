from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm.brute import lower, sha
from tideline.llm import exact_dedup


def expected(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(lower(text), []).append(i)
    return sorted(
        (i, max(groups[lower(t)]), len(groups[lower(t)]), i == max(groups[lower(t)]), sha(lower(t)))
        for i, t in rows
    )


def texts(n, seed):
    rng = random.Random(seed)
    alphabet = "abAé\n "
    return [
        (i, None if rng.random() < 0.05 else "".join(rng.choices(alphabet, k=rng.choice([0, 1, 2, 3, 9, 40]))))
        for i in range(n)
    ]


@pytest.mark.parametrize("bucket", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_groups_equal_brute_force_also_with_weak_buckets(spark, bucket):
    rows = texts(150, 3) + [(1000 + i, ("ab" * 50 + "c" * (i % 2))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_groups(docs, block_chars=4, bucket=bucket).select(
        "id", "keep_id", "group_size", "kept", "sha"
    )
    assert sorted(map(tuple, found.collect())) == expected(rows)


def test_null_ids_repeated_rows_and_extra_columns(spark):
    rows = [(None, "x", 1), (None, "X", 2), (3, "x", 3), (3, "x", 4), (4, None, 5), (5, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sha int")
    found = exact_dedup.exact_groups(docs).collect()
    kept = sorted((r.id, r.group_size) for r in found if r.kept)
    assert len(found) == 6 and kept == [(3, 4), (5, 2)]
    stays = exact_dedup.keep_one(docs)
    assert stays.columns == docs.columns
    assert sorted(r.doc_id for r in stays.collect()) == [3, 5]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(docs).count() == 0
    assert exact_dedup.keep_one(docs).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    docs = spark.createDataFrame(texts(20, 1), "doc_id long, text string")
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_keep_one_with_clashing_names(spark):
    rows = [(1, "A b", "p", 1), (2, "a B", "q", 2), (2, "a B", "r", 3), (None, "c", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string, _mark int")
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert len(found) == 2 and {tuple(r) for r in found} <= set(rows)
    assert sorted(r.text for r in found) == ["a B", "c"]
