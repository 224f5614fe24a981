import numpy as np
import pyarrow as pa
import pytest

from wavelake.llm import copies
from wavelake.llm.copies import features, group_links, groups, keep_one, likeness
from wavelake.llm.textarrays import flat

from .conftest import SF, WORD


def shingles(text):
    words = WORD.findall((text or "").encode().lower().decode())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def brute(texts):
    """The least index each text is joined with, by Jaccard similarity of all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j > i}:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def marks(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = {r.mark: r.component for r in groups(docs).collect()}
    found = docs.select("doc_id", copies._mark().alias("mark")).collect()
    return {r.doc_id: by[r.mark] for r in found}


def same_parts(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_whole_table_against_all_pairs(spark, documents):
    rows = [(i, t) for i, t, _ in documents]
    found = marks(spark, rows)
    assert same_parts([found[i] for i, _ in rows], brute([t for _, t in rows]))


def edits(base, random, share):
    words = list(base)
    for k in np.flatnonzero(random.random(len(words)) < share):
        words[k] = f"new{random.integers(1 << 30)}"
    return " ".join(words)


@pytest.mark.parametrize("group_rows", [4096, 16])
def test_edited_copies_are_found(spark, monkeypatch, group_rows):
    """Copies at all distances, a large group of them, and texts that share a passage only."""
    random = np.random.default_rng(group_rows)
    word = lambda n: [f"w{x}" for x in random.integers(0, 5000, n)]
    texts, passage = [], word(60)
    for share in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05):
        for _ in range(12):
            base = word(int(random.integers(80, 400)))
            texts += [" ".join(base), edits(base, random, share)]
    base = word(300)
    texts += [edits(base, random, 0.008) for _ in range(150)]
    texts += [" ".join([*word(150), *passage, *word(150)]) for _ in range(60)]
    monkeypatch.setattr(copies, "GROUP_ROWS", group_rows)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {r.mark: r.component for r in groups(docs, group_rows).collect()}
    found = {r.doc_id: by[r.mark] for r in docs.select("doc_id", copies._mark().alias("mark")).collect()}
    want = brute(texts)
    assert all(want[i] == want[j] for i in found for j in found if found[i] == found[j])  # nothing unlike is joined
    assert not [i for i in found if want[i] != i and found[i] != found[want[i]]]


def test_links_of_a_group_that_is_parted():
    random = np.random.default_rng(3)
    fp = np.full(500, 0x0123456789ABCDEF, np.uint64) ^ (np.uint64(1) << random.integers(0, 64, 500).astype(np.uint64))
    keys = [np.zeros(500, int) for _ in range(4)] + [np.sort(random.integers(0, 3, 500)), np.zeros(500, int)]
    order = np.lexsort((fp, *keys[::-1]))
    i, j = group_links([k[order] for k in keys], fp[order], 16)
    root = list(range(500))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    assert sum(r == k for k, r in enumerate(root)) == 1 and 499 <= len(i) <= 3 * 499


def test_features_and_likeness():
    texts = [None, "", " ", "a b", "A  B", "a b c d e f g", "a b c d e f g h " * 900]
    fp, least = features(pa.array(texts, pa.string()))
    assert fp[0] == fp[1] == fp[2] and fp[3] == fp[4] != fp[0] and (least[3] == least[4]).all()
    alone = [features(pa.array([t], pa.string())) for t in texts]
    assert all(f[0] == fp[k] and (m[0] == least[k]).all() for k, (f, m) in enumerate(alone))
    pairs = [("a b c d e f", "a b c d e g"), ("x", "x"), ("", " "), ("a b c d e f " * 50, "a b c d e f " * 40), ("p q", "r s")]
    want = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert likeness(*([x.encode() for x in side] for side in zip(*pairs, strict=True))) == pytest.approx(want)
    assert flat([b"a"])[1].tolist() == [0, 1]


def test_odd_rows(odd):
    kept = keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 7, 9, 10]
    assert keep_one(odd.limit(0)).count() == 0
    clash = odd.toDF(*["doc_id", "text", "_mark", "_component", "_chosen", "mark", "node"])
    assert keep_one(clash).columns == clash.columns and keep_one(clash).count() == 5


def test_each_group_keeps_a_document(spark):
    """Whatever ids its rows have: none, or ones that other texts have too."""
    text = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("b")), (None, text("c")), (None, text("c")), (5, text("d")), (5, text("e")), (5, text("e")), (6, text("e")), (3, text("f")), (None, text("f")), (6, text("g"))]
    kept = keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text[0]) for r in kept) == [(0, "a"), (0, "b"), (0, "c"), (3, "f"), (5, "d"), (5, "e"), (6, "g")]
