import numpy as np
import pytest

import corpus_pipeline
from wavelake.llm.common import written

from .conftest import SF, WORD
from .test_copies import brute as alike
from .test_packing import exact
from .test_passages import brute


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, SF))
        out.append((name, before, docs))
    return {name: (before, after) for name, before, after in out}


def test_stages_pass_documents_on(steps):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "passages", "mixing", "packing"]
    for name in list(steps)[:-1]:
        before, after = steps[name]
        assert after.dtypes == before.dtypes and after.count() > 0


def test_good_documents_stay(spark, steps):
    before, after = steps["quality"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert np.mean([i in kept for i, q in labels.items() if q == 1]) > 0.95


def test_one_of_each_group_stays(steps):
    before, after = (x.orderBy("doc_id").collect() for x in steps["near_duplicates"])
    # Rows are in order of doc_id, so the least index of a group is its least id.
    assert after == [r for k, (r, c) in enumerate(zip(before, alike([r.text for r in before]), strict=True)) if k == c]


def test_passages_go(steps):
    before, after = (x.orderBy("doc_id").collect() for x in steps["passages"])
    want = brute([(r.doc_id, r.text) for r in before], 20)
    after = {r.doc_id: r for r in after}
    for r in before:
        n, kept = want[r.doc_id]
        if n and not kept:
            assert r.doc_id not in after
        else:
            assert after[r.doc_id].text == (r.text if len(kept) == n else " ".join(kept)) and after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_sources_are_mixed(steps):
    before, after = (x.collect() for x in steps["mixing"])
    times = {r.doc_id: 0 for r in before}
    for r in after:
        times[r.doc_id] += 1
    assert max(times.values()) <= 3
    words = lambda rows: sum(len(WORD.findall(r.text or "")) for r in rows)
    assert words(after) == pytest.approx(words(before), rel=0.15)


def test_sequences_hold_all_that_is_left(steps):
    before, after = (x.collect() for x in steps["packing"])
    assert sum(r.length for r in after) == sum(len(x) for x in exact([r.text for r in before]))


def test_odd_rows(spark, odd):
    docs = odd
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        left[name] = sorted((r.doc_id or 0) for r in docs.collect())
    # One of the rows of equal text stays, one of texts without words; what repeats a passage loses it.
    assert set(left["near_duplicates"]) <= set(left["quality"]) and len(left["near_duplicates"]) == len(set(left["near_duplicates"]))
    assert set(left["passages"]) == set(left["near_duplicates"]) and set(left["mixing"]) <= set(left["passages"]) and left["packing"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), SF).count() == 0
