import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.llm import maxent
from wavelake.llm.common import crc_mod

from .conftest import SF, WORD


def tokens(text):
    return WORD.findall((text or "").encode().lower().decode()) + ["\n"]


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in maxent.op2_maxent(spark, SF).collect()}


def test_counts_and_base_scores(found, documents):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _, _ in documents}
    counts = Counter(w for i, t, _ in documents if not held[i] for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(documents)
    for i, t, _ in documents:
        r, ws = found[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel=1e-9)


def test_better_than_the_base_on_held_out_texts(found):
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_tail_words_score_alike_whether_broadcast_or_joined(spark, found, monkeypatch):
    monkeypatch.setattr(maxent, "HEAD", 300)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = {r.doc_id: r for r in maxent.score(docs, crc_mod("doc_id", 5) == 1).collect()}
    assert all(few[i].base_score == pytest.approx(r.base_score, rel=1e-9) and few[i].n_known == r.n_known for i, r in found.items())


def test_probabilities_sum_to_one():
    """Over all classes, and over all branches of all classes, in any context."""
    random = np.random.default_rng(0)
    bits = 6
    weights = random.normal(size=(2 * maxent.FEATURES, 1 << bits, maxent.CLASSES)).astype(np.float32)
    bias, inner = (random.normal(size=n).astype(np.float32) for n in (maxent.CLASSES, (maxent.CLASSES, maxent.BRANCHES)))
    contexts = maxent.contexts_of(*random.integers(0, 1 << 32, (3, 50), dtype=np.uint32))
    each = [maxent.log_shares(weights[: maxent.FEATURES], bias, maxent.rows_of(contexts, bits), np.full(50, k)) for k in range(maxent.CLASSES)]
    assert np.exp(each).sum(0) == pytest.approx(np.ones(50), abs=1e-4)
    kinds = [k * maxent.BRANCHES + j for k in range(maxent.CLASSES) for j in range(maxent.BRANCHES if k > maxent.SINGLES else 1)]
    each = [maxent.log_probability(weights, bias, inner, contexts, np.full(50, k), bits) for k in kinds]
    assert np.exp(each).sum(0) == pytest.approx(np.ones(50), abs=1e-3)


def test_branches_of_words():
    words = [(f"w{k}".encode(), 500 - k) for k in range(300)]
    lexicon = maxent.Lexicon(words, maxent.clustered([w for w, _ in words], np.array([c for _, c in words], float)), 3)
    kind, count = lexicon.known(*known(lexicon, [w for w, _ in words]))
    assert count.tolist() == [c for _, c in words] and kind[: maxent.SINGLES].tolist() == [(1 + k) * maxent.BRANCHES for k in range(maxent.SINGLES)]
    own = [k for k in kind[maxent.SINGLES :].tolist() if k % maxent.BRANCHES < maxent.OWN]
    assert len(set(own)) == len(own)  # a branch below OWN is one word's
    for group in set(kind[maxent.SINGLES :] // maxent.BRANCHES):
        branches = [k % maxent.BRANCHES for k in kind[maxent.SINGLES :].tolist() if k // maxent.BRANCHES == group]
        assert branches[: maxent.OWN] == list(range(min(len(branches), maxent.OWN))) and all(x >= maxent.OWN for x in branches[maxent.OWN :])
    unseen, none = lexicon.known(*known(lexicon, [b"zebra", b"q"]))
    assert none.tolist() == [-1, -1] and (unseen % maxent.BRANCHES >= maxent.OWN).all()


def known(lexicon, words):
    from wavelake.llm.textarrays import Words, flat

    data, offsets = flat(words)
    w = Words(data, offsets)
    return w.hashes(lower=True), data, w.start, w.end


def test_gradient_steps_learn_a_context():
    bits = 13
    trainer = maxent.Trainer(np.zeros((maxent.FEATURES, 1 << bits, maxent.CLASSES), np.float32), np.zeros(maxent.CLASSES, np.float32))
    random = np.random.default_rng(1)
    h = random.integers(0, 4, (3, 4000)).astype(np.uint32) * np.uint32(0x01234567)
    kind = (h[0] // 0x01234567).astype(np.uint8)
    rows = maxent.rows_of(maxent.contexts_of(*h), bits)
    for _ in range(80):
        trainer.step(rows, kind)
    assert np.exp(maxent.log_shares(trainer.weights, trainer.bias[:, 0], rows, kind)).mean() > 0.9
    assert trainer.used.sum() == 80 * 4000 * maxent.FEATURES
    assert [maxent.row_bits(n) for n in (0, 10**8, 10**9, 10**10, 10**13)] == [13, 13, 13, 16, 16]


def test_words_follow_their_contexts(spark):
    """In a corpus where a word is certain after another, the model has learnt so; it knows the words of a class apart."""
    random = np.random.default_rng(5)
    pairs = {f"lead{k}": f"next{k}" for k in range(40)}
    rows = []
    for i in range(600):
        leads = random.choice(list(pairs), 60)
        rows.append((i, " ".join(w for a in leads for w in (a, pairs[a] if i < 560 else random.choice(list(pairs.values()))))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in maxent.score(docs, F.col("doc_id") >= 520).collect()}
    right = np.mean([(found[i].score - found[i].base_score) / found[i].n_tokens for i in range(520, 560)])
    wrong = np.mean([(found[i].score - found[i].base_score) / found[i].n_tokens for i in range(560, 600)])
    assert right > 0.3 and right > wrong + 0.3


def test_odd_rows(odd):
    rows = {}
    for r in maxent.score(odd, crc_mod("doc_id", 5) == 1).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert rows[1][0].n_tokens == rows[2][0].n_tokens == 1 and len(rows[7]) == 2 and rows[7][0].score == pytest.approx(rows[7][1].score)
    assert maxent.score(odd.limit(0), F.lit(False)).count() == 0
    untrained = maxent.score(odd, F.lit(True)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and math.isfinite(r.score) for r in untrained)
