import numpy as np
import pyarrow as pa
import pytest

from wavelake.llm import ngramjoin
from wavelake.llm.blocks import least_shared
from wavelake.llm.ngramjoin import jaccard_join, prefix, sets

from .conftest import WORD

LOWER = {a: a + 32 for a in range(65, 91)}


def shingled(text):
    ws = WORD.findall((text or "").translate(LOWER))
    return {" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))} if ws else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) of each row, in order, by comparing all pairs."""
    own = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(own[i] & own[j])
            if own[i] and own[j] and 100 * both >= 85 * (len(own[i]) + len(own[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if own[i] and d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(own[i]), least.get(top(i)) if own[i] else d) for i, (d, _) in enumerate(rows)]


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join(docs, **how).collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = brute(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    return want


def changed(text, random, n):
    ws = text.split()
    for i in random.integers(0, len(ws), n).tolist():
        ws[i] = f"e{random.integers(0, 10**9)}"
    return " ".join(ws)


def corpus(random):
    """Copies at all distances around the bound, groups of near copies, and texts that share a passage."""
    word = lambda n: [f"w{x}" for x in random.integers(0, 3000, n)]
    texts, passage = [], word(60)
    for n in range(0, 9):
        for _ in range(8):
            base = " ".join(word(int(random.integers(60, 300))))
            texts += [base, changed(base, random, n), base.upper()]
    base = " ".join(word(200))
    texts += [changed(base, random, int(random.integers(0, 12))) for _ in range(120)]
    texts += [" ".join([*word(int(k)), *passage]) for k in random.integers(1, 40, 40)]
    return texts


@pytest.mark.parametrize("group_rows", [4096, 7])
def test_against_all_pairs(spark, group_rows):
    random = np.random.default_rng(group_rows)
    texts = corpus(random)
    rows = [(int(i), t) for i, t in zip(random.permutation(len(texts)), texts, strict=True)]
    want = check(spark, rows, group_rows=group_rows)
    linked = sum(d != c for d, _, c in want)
    assert 100 < linked < len(rows) - 50


def test_pairs_only_the_second_round_finds(spark, monkeypatch):
    """Without the neighbours' round all links come through the filters."""
    empty = lambda grouped, *more: grouped.selectExpr("node as u", "node as v").limit(0)
    monkeypatch.setattr(ngramjoin, "neighbours", empty)
    texts = corpus(np.random.default_rng(3))
    check(spark, list(enumerate(texts)), group_rows=50)


def test_short_and_odd_texts(spark):
    rows = [(5, "a b"), (3, "A  B"), (4, "a b c"), (1, None), (2, ""), (6, " \t\n"), (None, "a b"), (None, None), (7, "a b c d"), (8, "a b c d e"), (7, "x y"), (7, "x y"), (9, "a a a a a a a"), (10, "A a a a\va")]
    want = check(spark, rows)
    assert (5, 1, 3) in want and (None, 1, 3) in want and (1, 0, 1) in want and (10, 1, 9) in want


def test_odd_rows(spark, odd):
    got = sorted(tuple(r) for r in jaccard_join(odd).where("doc_id is not null").collect())
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got == sorted(r for r in brute(rows) if r[0] is not None)


def test_no_rows(spark):
    assert jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    check(spark, [(1, None), (2, "")])


def test_bounds():
    for m in range(1, 80):
        assert prefix(np.array([m]))[0] == m - min(i for i in range(m + 1) if 100 * i >= 85 * m) + 1
        for n in range(1, 80):
            assert least_shared(m, n, 85) == next(i for i in range(m + n) if 100 * i >= 85 * (m + n - i))


def test_sets_of_texts():
    texts = ["a b c d a b c d", "", None, "x", "X", "a  b\tc d"]
    h, edge = sets(pa.array(texts))
    assert np.diff(edge).tolist() == [len(shingled(t)) for t in texts]
    assert h[edge[3]] == h[edge[4]] and h[edge[5]] in h[: edge[1]]
