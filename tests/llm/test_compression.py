import math
import random
import re
from collections import Counter

import zstandard

from wavelake.llm.compression import BANDS, CHUNK_BAND, judge, op6_compression

from .conftest import SF, WORD


def base(text):
    words = WORD.findall(text)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    counts, repeated = Counter(triples), set()
    for k, t in enumerate(triples):
        if counts[t] > 1:
            repeated.update((k, k + 1, k + 2))
    seen, lines = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(repeated)


def test_whole_table_against_plain_counts(spark, documents):
    rows = {r.doc_id: r for r in op6_compression(spark, SF).collect()}
    assert len(rows) == len(documents)
    for i, t, _ in documents:
        r, want = rows[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)


def verdict(text):
    """Whether a text passes the bands, one chunk after the other."""
    def ratio(x):
        return len(x) / len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(x))

    def band(x):
        low, high = 0, math.inf
        for least, a, b in BANDS:
            low, high = (a, b) if len(x) >= least else (low, high)
        return low <= ratio(x) <= high

    data = text.encode()
    if not data:
        return True
    chunks = [data[k : k + 4096] for k in range(0, len(data), 4096)]
    outside = sum(len(c) for c in chunks if not (CHUNK_BAND[0] <= ratio(c) <= CHUNK_BAND[1] if len(c) == 4096 else band(c)))
    return band(data) and 2 * outside <= len(data)


def test_verdicts_against_plain_chunks(spark, documents):
    noise = random.Random(2)
    junk = "".join(chr(noise.randrange(33, 127)) for _ in range(4000))
    texts = [t or "" for _, t, _ in documents]
    texts += [texts[0][:4096] + junk, junk, " ".join(texts[1:9])[:4000] + " " + junk[:2000], "same words again " * 900]
    rows = {r.doc_id: r for r in judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert rows[i].kept == (verdict(t) and not rows[i].base_failed) and rows[i].n_chunks == -(-len(t.encode()) // 4096)
    assert not rows[len(documents)].kept  # what lies in the last chunk alone counts


def test_sql_of_the_counts(spark):
    import duckdb

    from wavelake.llm.queries import QUERIES, SQL

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    for name in ("compression_counts", "mixing_targets"):
        df = QUERIES[name](spark, SF)
        found = c.execute(SQL[name])
        at = [[d[0] for d in found.description].index(k) for k in df.columns]
        assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in found.fetchall())


def test_good_documents_stay_and_extremes_go(spark, documents):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in op6_compression(spark, SF).collect()}
    good = [r for i, r in rows.items() if labels.get(i) == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    noise = random.Random(1)
    texts = [" ".join("".join(map(chr, noise.choices(range(33, 127), k=20))) for _ in range(200)), " ".join(f"item {i % 7} of the same list number {i}" for i in range(2000)), "a\nb\n\na\nb \na\n" * 2]
    found = {r.doc_id: r for r in judge(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert not any(r.kept for r in found.values()) and found[2].n_dup_lines == base(texts[2])[3]


def test_odd_rows(odd):
    rows = judge(odd).collect()
    assert len(rows) == 9 and sum(r.n_words == 0 for r in rows) == 2 and judge(odd.limit(0)).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[10].n_words == 30_000 and by[10].n_chunks > 10 and by[7].base_failed
