from __future__ import annotations

from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_mixing import targets
from tideline.llm import quality
from tideline.session import materialise

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and the rows after each stage."""
    found = [spark.read.parquet(f"{SF_DIR}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(materialise(stage(spark, found[-1], SF_DIR)))
    return found


def test_stages_keep_the_columns_of_documents(stages):
    for after in stages[1:-1]:
        assert after.schema.simpleString() == stages[0].schema.simpleString()


def test_quality_stage_keeps_what_scores_half(spark, stages):
    docs, kept = stages[0], stages[1]
    model = quality.train(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    import numpy as np

    rows = docs.collect()
    scores = model.score(np.vstack([quality.describe(r.text) for r in rows]).astype(float))
    assert Counter(kept.collect()) == Counter(r for r, s in zip(rows, scores) if s >= 0.5)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [r.doc_id for r in rows if labels.get(r.doc_id) == 1]
    # Nine in ten even from the 50 labels of this table; test_quality has a larger one.
    assert len(set(good) & {r.doc_id for r in kept.collect()}) > 0.9 * len(good)


def test_exact_stage_keeps_the_largest_id(stages):
    last = {}
    for r in stages[1].collect():
        key = brute.lower(r.text)
        last[key] = max(last.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(last.values())


def test_near_stage_keeps_the_smallest_id_of_each_component(stages):
    rows = sorted(stages[2].collect(), key=lambda r: r.doc_id)
    where, sizes = brute.components([r.text for r in rows], 5, 80, 100)
    want = [r.doc_id for i, r in enumerate(rows) if where[i] == i]
    assert sorted(r.doc_id for r in stages[3].collect()) == want


def test_mixing_stage_meets_its_targets(stages):
    rows = {r.doc_id: r for r in stages[3].collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows.values():
        sizes[r.source] += len(brute.WORD.findall(r.text or ""))
    copies = Counter(r.doc_id for r in stages[4].collect())
    for i, n in copies.items():
        assert n <= 2
        taken[rows[i].source] += n * len(brute.WORD.findall(rows[i].text or ""))
    for source, target in targets(dict(sizes)).items():
        most = max(len(brute.WORD.findall(r.text or "")) for r in rows.values() if r.source == source)
        assert abs(taken[source] - target) <= most / 2


def test_packing_stage_holds_each_document_as_often(stages):
    tokens = defaultdict(int)
    whole = {}
    for p in stages[5].collect():
        tokens[p.doc_id] += p.length
        whole[p.doc_id] = p.doc_tokens
    copies = Counter(r.doc_id for r in stages[4].collect())
    assert {i: n * whole[i] for i, n in copies.items()} == dict(tokens)


def test_run_gives_the_last_stage(spark, stages):
    found = corpus_pipeline.run(spark, SF_DIR)
    key = lambda r: (r.doc_id, r.start, r.length, r.doc_tokens)
    assert found.agg({"length": "sum"}).first()[0] == stages[5].agg({"length": "sum"}).first()[0]
    assert {key(r)[0] for r in found.collect()} == {r.doc_id for r in stages[5].collect()}
