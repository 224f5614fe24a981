import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from wavelake.llm.passages import drop_repeats, op5_passages, without_repeats

from .conftest import SF, WORD


def brute(rows, size):
    """{id: (words, kept words)} by looking at all windows."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), (i, k))
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - size + 1):
            if first[tuple(ws[k : k + size])] != (i, k):
                gone.update(range(k, k + size))
        out[i] = (len(ws), [w for k, w in enumerate(ws) if k not in gone])
    return out


def test_whole_table_against_all_windows(spark, documents):
    rows = op5_passages(spark, SF).collect()
    want = brute([(i, t) for i, t, _ in documents], 20)
    assert len(rows) == len(want)
    for r in rows:
        n, kept = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab é\n\t", max_size=40), max_size=8), st.sampled_from([16, 29]))
def test_short_windows_of_few_words(spark, texts, bits):
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 3, bits).collect()}
    for i, (n, kept) in brute(rows, 3).items():
        assert (found[i]["_n_words"], found[i]["_kept_text"]) == (n, " ".join(kept))


def test_a_full_sketch_loses_nothing(spark, documents, monkeypatch):
    from wavelake.llm import passages

    monkeypatch.setattr(passages, "LEAST_BITS", 11)
    monkeypatch.setattr(passages, "BLOCK_BITS", 3)
    rows = [(i, t) for i, t, _ in documents]
    found = {r.doc_id: r["_kept_text"] for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 11).collect()}
    assert all(found[i] == " ".join(kept) for i, (_, kept) in brute(rows, 20).items())


def test_many_chunks_and_shared_ids(spark, monkeypatch):
    """Chunks of a few hundred bytes; texts that share an id, rows that repeat, without an id too, in several chunks."""
    from wavelake.llm import passages

    monkeypatch.setattr(passages, "CHUNK_BYTES", 300)
    monkeypatch.setattr(passages, "BLOCK_BITS", 2)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(k % 9 if k % 4 else None, f"{'a b c ' * (k % 7)} {passage if k % 3 else ''} t{k % 11}") for k in range(80)]
    found = [(r.doc_id, r.text, r["_kept_text"]) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(1), 4).collect()]
    assert sorted((r[0] or -1, r[1]) for r in found) == sorted((r[0] or -1, r[1]) for r in rows)
    # Documents in order: by id, then by a hash of the text; equal rows are one.
    import xxhash

    key = lambda r: (-(1 << 63) if r[0] is None else r[0], xxhash.xxh64_intdigest(r[1].encode()) >> 1 if sum(q[0] == r[0] for q in rows) > 1 else 0)
    one = {key(r): r[1] for r in rows}
    want = brute(list(one.items()), 4)
    assert all(kept == " ".join(want[key((i, t))][1]) for i, t, kept in found)


def test_share_of_windows_passed_on(spark, documents):
    """A sketch of four cells a window lets few windows through that occur once; one of a cell for ten of them lets all."""
    from wavelake.llm.passages import Layout

    assert [Layout(n, 16).bits for n in (10**6, 10**9, 10**12, 10**14)] == [20, 30, 40, 46]
    assert [(Layout(n, 16).low, Layout(n, 16).chunk >> 20) for n in (10**9, 10**14)] == [(22, 12), (26, 192)]


def test_odd_rows(odd):
    found = drop_repeats(odd)
    assert found.columns == [*odd.columns, "_n_words", "_n_removed", "_kept_text"]
    by = {}
    for r in found.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[1][0]["_n_words"] == 0 and by[2][0]["_kept_text"] == ""
    assert [r["_n_removed"] for r in by[7]] == [118, 118] and by[7][0].text == "x y " * 60
    assert by[10][0]["_n_removed"] == 0 and by[11][0]["_kept_text"] == "tail" and by[11][0]["component_id"] == ""
    assert drop_repeats(odd.limit(0)).count() == 0
    kept = {r.doc_id: r for r in without_repeats(odd).collect()}
    assert kept[11].text == "tail" and kept[11].n_chars == 4 and kept[1].text is None
