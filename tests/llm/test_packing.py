import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from wavelake.llm.packing import WordTokens, op1_packing, pack, tokenizer_path
from wavelake.llm.textarrays import flat

from .conftest import SF

ODD = [
    "", "  ", "hello <|endoftext|> x <|ENDOFTEXT|>", "áb É x y  'S don't it'll", "\x01 a\x01b \x01\x01 c", "İstanbul ΑΣ ΑΣ. ß ﬁ 漢字かな 123 4½", "x" * 5000,
    "don't I'll he'd, a.b.c x=1,2;3 (a)'s ,'re 'lla, é, É! ñ.# 5% a&b", "a̸= ≠ x́. ≮", "…a… a'b's",
]


def exact(texts):
    return [[*e.ids, 1] for e in Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_tokenizers(documents):
    words, texts = WordTokens(tokenizer_path()), [t for _, t, _ in documents] + ODD
    for group in (texts, ODD, *([x] for x in ODD)):
        ids, edges = words.ids(*flat([x.encode() for x in group]), 1)
        assert [ids[i:j].tolist() for i, j in zip(edges[:-1], edges[1:], strict=True)] == exact(group)


def test_whole_documents_in_gapless_sequences(spark, documents):
    rows = op1_packing(spark, SF).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for (doc, _, _), ids in zip(documents, exact([t for _, t, _ in documents]), strict=True):
        ids, at = np.array(ids, "<u4"), 0
        for r in sorted(pieces.pop(doc), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    assert not pieces
    filled = []
    for s in sorted(sequences):
        at = 0
        for offset, length in sorted(sequences[s]):
            assert offset == at
            at += length
        filled.append(at)
    assert sorted(sequences) == list(range(len(sequences))) and set(filled[:-1]) == {2048} and 0 < filled[-1] <= 2048


@pytest.mark.parametrize("weights", [None, "given"])
def test_sequences_follow_target_shares(spark, documents, weights):
    docs = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t, _ in documents] + [(1000 + i, t, "ab"[i % 2]) for i, t, _ in documents], "doc_id long, text string, source string")
    shares = {"a": 3.0, "b": 1.0} if weights else None
    rows = pack(docs, shares, 512).collect()
    size, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        size["ab"[r.doc_id % 2]] += r.length
        longest["ab"[r.doc_id % 2]] = max(longest["ab"[r.doc_id % 2]], r.doc_tokens)
    share = {k: v / sum(size.values()) for k, v in size.items()} if not weights else {"a": 0.75, "b": 0.25}
    taken = defaultdict(int)
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for s in sorted(by):
        for r in by[s]:
            taken["ab"[r.doc_id % 2]] += r.length
        if weights and taken["a"] > size["a"] - longest["a"] - 512:
            break
        for k in "ab":  # a deficit is less than a document, and is carried over all sequences
            assert abs(taken[k] - share[k] * 512 * (s + 1)) <= longest["a"] + longest["b"] + 512


def test_odd_rows(odd):
    rows = pack(odd).collect()
    whole = defaultdict(int)
    for r in rows:
        whole[r.doc_id] += r.length
    assert whole[1] == 1 and whole[2] == 1 and whole[9] == 3 and sum(whole.values()) == 2048 * max(r.sequence_id for r in rows) + sum(r.length for r in rows if r.sequence_id == max(r.sequence_id for r in rows))
    assert pack(odd.limit(0)).count() == 0
