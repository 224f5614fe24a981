import numpy as np
import pytest
import xxhash

from wavelake.llm.components import components
from wavelake.llm.simhash import blocks_of, fingerprint, links, near_duplicates, op10_simhash

from .conftest import SF, WORD


def plain(text):
    words = WORD.findall((text or "").encode().lower().decode())
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def groups(fps, names):
    """Least name reachable of each, comparing all pairs."""
    fps = np.array(fps, np.uint64)
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, j in zip(*np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3), strict=True):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    least = {}
    for i, n in enumerate(names):
        least[find(i)] = min(n, least.get(find(i), n))
    return [least[find(i)] for i in range(len(names))]


def test_whole_table_against_all_pairs(spark, documents):
    rows = {r.doc_id: r for r in op10_simhash(spark, SF).collect()}
    fps = [plain(t) for _, t, _ in documents]
    want = groups(fps, [i for i, _, _ in documents])
    for (i, _, _), fp, c in zip(documents, fps, want, strict=True):
        assert (rows[i].fingerprint, rows[i].component_id) == (f"{fp:016x}", c)


def test_more_fingerprints_have_longer_blocks():
    assert [blocks_of(n, 3, 4096) for n in (10, 1 << 28, (1 << 28) + 1, 10**11)] == [(4, 1), (4, 1), (5, 2), (6, 3)]


@pytest.mark.parametrize("group_rows", [4096, 50, 8, 1])
def test_links_join_what_is_near(spark, group_rows):
    random = np.random.default_rng(group_rows)
    centres = random.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = set()
    for _ in range(900):
        x = int(centres[random.integers(12)])
        for b in random.integers(0, 64, random.integers(0, 9)):
            x ^= 1 << int(b)
        fps.add(x)
    signed = [int(np.uint64(x).astype(np.int64)) for x in sorted(fps)]
    names = list(range(len(signed)))
    found = links(spark.createDataFrame(list(zip(signed, names, strict=True)), "fp long, node long"), 3, group_rows)
    assert found.count() <= 20 * 15 * len(fps)
    got = {r.node: r.component for r in components(found).collect()}
    assert [got.get(n, n) for n in names] == groups(sorted(fps), names)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + k: 100 for k in range(1, 50)}, 300: 299}


def test_short_texts():
    assert [fingerprint(x) for x in (None, "", " \t", "A b", "a B c", "a b c D")] == [plain(x) for x in (None, "", " \t", "A b", "a B c", "a b c D")]
    assert fingerprint("w " * 2000) == plain("w " * 2000)


def test_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == 9 and near_duplicates(odd.limit(0)).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].component_id == by[2][0].component_id == 1 and [r.component_id for r in by[None]] == [None, None] and by[11][0].component_id == 10
