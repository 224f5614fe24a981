import hashlib

import numpy as np
import pytest

from wavelake.llm.piecewise import _similar, edited, fingerprints, likeness, op3_piecewise, prints

from .conftest import SF


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_whole_table_against_each_text_alone(spark, documents):
    rows = {r.doc_id: r for r in op3_piecewise(spark, SF).collect()}
    assert len(rows) == len(documents)
    texts = [t for _, t, _ in documents]
    for k, (i, t, _) in enumerate(documents):
        after = texts[(k + 1) % len(texts)]
        changed = edited(t, after)
        own, new, following = (prints([x.encode()]) for x in (t, changed, after))
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert [r.fingerprint] == own.strings() and [r.edited_fingerprint] == new.strings()
        assert r.near_edited == pytest.approx(likeness(own, new)[0]) and r.near_next == pytest.approx(likeness(own, following)[0])


def test_edits_stay_near_and_others_do_not(documents):
    texts = [t for _, t, _ in documents]
    after = texts[1:] + texts[:1]
    own, new = prints([x.encode() for x in texts]), prints([edited(a, b).encode() for a, b in zip(texts, after, strict=True)])
    near, far = likeness(own, new), likeness(own, own.take(np.r_[1 : len(texts), 0]))
    assert near.min() > 0.25 and np.median(near) > 0.65 and np.median(far) < 0.1
    assert (likeness(own, own) == 1).all()


def test_likeness_is_the_edit_distance():
    random = np.random.default_rng(3)
    for _ in range(20):
        a, b = (random.integers(0, 8, random.integers(0, 65)).astype(np.int16) for _ in range(2))
        x, y = (np.full((1, 64), -1, np.int16) for _ in range(2))
        x[0, : len(a)], y[0, : len(b)] = a, b
        assert _similar(x, y)[0] == pytest.approx(2 * subsequence(a.tolist(), b.tolist()) / max(1, len(a) + len(b)))


def test_odd_rows(odd):
    rows = fingerprints(odd).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].fingerprint == by[2][0].fingerprint == "1::" and by[1][0].near_next == 1.0
    assert by[7][0].fingerprint == by[7][1].fingerprint and by[10][0].near_next > 0.9
    assert fingerprints(odd.limit(0)).count() == 0 and fingerprints(odd.limit(1)).first().near_next == 1.0
