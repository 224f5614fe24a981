"""Mixture-controlled packing of documents into sequences by deficit round-robin.

Each source is a queue of documents. In every round a source's deficit grows by its quantum, its
target share of a sequence, and it sends documents while the deficit covers them; what is left is
carried on. Rounds go on without regard to where a sequence ends: one that is full is closed, and
the document goes on in the next, so that only the last sequence of all is padded and deficits pass
over sequences and tasks alike.

No task has to play the rounds one after the other. While queues are full, a source has earned
r * quantum after r rounds, so the document that brings its sent tokens to c goes out in round
ceil(c / quantum): a running sum by source. Ordered by round, source and place in the queue, a
second running sum over all documents is the position in the stream of sequences. Both sums are
taken in two levels, within buckets and over the buckets' totals, so no source or round is one
task's work.

Defined cases: null text is an empty document, which is its end token alone; null is a source of its
own; repeated rows are documents of their own (their mutual order is open); a document longer than a
sequence spans several; no rows give no rows. Queues are in a seeded hash order of the id.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import compact, table, written
from .textarrays import Words, slices, utf8

LENGTH, END_ID = 2048, 1
TOKENIZER = "word_bpe_49k.json"
#: Units whose ids a worker remembers; rows of a bucket of small inputs; buckets of these; rounds of a block of the stream.
REMEMBERED, BUCKET_ROWS, LEAST_BUCKETS, BLOCK_ROUNDS = 1_500_000, 2_500, 256, 256
#: Buckets of a queue and blocks of the stream at most: so many totals go through one task; beyond it these grow.
MOST_TOTALS = 1 << 16


_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN[[k for k in range(33, 127) if not _LETTER[k]]] = True


class WordTokens:
    """Ids of texts under a tokenizer whose tokens span neither white space nor a sign after an ASCII letter or digit.

    Texts fall into units at those places. The ids of a unit are looked up by its hash, and those of
    new units come from the tokenizer, many at a time. What is known is held in arrays: a large sorted
    one and a small one that is merged into it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # A unit of its own whose one id parts the units that are looked up together.
        self.mark = "\x01"
        ids = self.tokenizer.encode(self.mark, add_special_tokens=False).ids
        self.mark_id = ids[0] if len(ids) == 1 else None
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self):
        none = np.zeros(0, np.int64)
        self.large = self.small = (np.zeros(0, np.uint64), none, none)  # hashes in order, starts and lengths in the pool
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _new(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units one after the other, and how many are each unit's."""
        if self.mark_id is not None and not any(b"\x01" in u for u in units):
            ids = self._encode(b" \x01 ".join([*units, b""]).decode())
            marks = ids == self.mark_id
            stop = np.flatnonzero(marks)
            if len(stop) == len(units):
                return ids[~marks], np.diff(stop, prepend=-1) - 1
        parts = [self._encode(u.decode()) for u in units]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each unit's ids in the pool; start -1 if it is not known."""
        start, length = np.full(len(hashes), -1), np.zeros(len(hashes), np.int64)
        for keys, starts, lengths in (self.large, self.small):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                start[hit], length[hit] = starts[at[hit]], lengths[at[hit]]
        return start, length

    def _learn(self, hashes: np.ndarray, units: list[bytes]) -> None:
        found, lengths = self._new(units)
        total = len(found)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = found
        new = (hashes, self.used + np.cumsum(lengths) - lengths, lengths)
        self.used += total
        self.small = self._merged(self.small, new)
        if len(self.small[0]) > REMEMBERED // 16:
            self.large, self.small = self._merged(self.large, self.small), tuple(x[:0] for x in self.small)

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def ids(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after the other, each with end_id, and where each begins."""
        if len(self.large[0]) > REMEMBERED:
            self._forget()
        words = Words(data, offsets, cut=(_LETTER, _SIGN))
        hashes, first, back = np.unique(words.hashes(lower=True), return_index=True, return_inverse=True)
        start, length = self._find(hashes)
        new = np.flatnonzero(start < 0)
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], [raw[i:j] for i, j in zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)])
            start[new], length[new] = self._find(hashes[new])
        start, length = start[back], length[back]
        of_unit = np.repeat(np.arange(len(offsets) - 1), np.diff(words.of))
        begin = np.cumsum(length) - length
        total = int(length.sum())
        at = np.arange(total) + np.repeat(start - begin, length)
        edges = np.concatenate([begin, [total]])[words.of] + np.arange(len(offsets))
        out = np.full(total + len(offsets) - 1, end_id, self.kind)
        out[np.arange(total) + np.repeat(of_unit, length)] = self.pool[at]
        return self._specials(data, offsets, end_id, out, edges)

    def _specials(self, data, offsets, end_id, out, edges):
        """Texts that hold the tokenizer's special strings are read by it as a whole."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return out, edges
        texts = [raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        parts = [np.append(self._encode(t.decode()), self.kind.type(end_id)) if any(s in t for s in self.special) else out[i:j] for t, i, j in zip(texts, edges[:-1], edges[1:], strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


@lru_cache(2)
def _tokens(path: str) -> WordTokens:
    return WordTokens(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n, ids (binary, little-endian, two bytes each or four) of every row."""

    def batches(rows):
        words = _tokens(path)
        size = words.kind.itemsize
        for b in rows:
            data, offsets = utf8(b.column(2))
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                ids, edges = words.ids(data[part[0] : part[-1]], part - part[0], end_id)
                out = pa.BinaryArray.from_buffers(pa.binary(), last - first, [None, pa.py_buffer((edges * size).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.record_batch([b.column(0)[first:last], b.column(1)[first:last], pa.array(np.diff(edges)), out], ["doc_id", "source", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, source string, n long, ids binary")


def positions(rows: DataFrame, weights: dict | None = None, length: int = LENGTH, bucket_rows: int = BUCKET_ROWS, block_rounds: int = BLOCK_ROUNDS) -> DataFrame:
    """(row, doc_id, source, n) -> (row, position): where each document starts in the stream of sequences.

    weights: target shares of the sources (others 1); absent, the sources' own token shares, with
    which all queues end together.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    count, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    buckets = min(MOST_TOTALS, max(1, min(LEAST_BUCKETS, count // 50), -(-count // bucket_rows)))
    # Rounds grow with the queue that has most of them; with given weights a small share makes more.
    block_rounds = max(block_rounds, -(-tokens // (length * MOST_TOTALS)))
    order = F.xxhash64(F.lit(1), "doc_id")
    d = rows.select("row", "doc_id", "n", key.alias("queue"), order.alias("h")).withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    totals = d.groupBy("queue", "bucket").agg(F.sum("n").alias("total"))
    totals = written(totals)
    earlier = Window.partitionBy("queue").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = totals.groupBy("queue").agg(F.sum("total").alias("own"))
    if weights is None:
        own = own.select(F.col("queue").alias("_q"), (F.col("own") / F.lit(float(max(tokens, 1)))).alias("share"))
    else:
        given = F.create_map(*[x for k, w in weights.items() for x in (F.lit("null" if k is None else "=" + k), F.lit(float(w)))]) if weights else F.lit(None).cast("map<string,double>")
        own = own.select(F.col("queue").alias("_q"), F.coalesce(F.try_element_at(given, "queue"), F.lit(1.0)).alias("w"))
        every = own.agg(F.sum("w")).first()[0] or 1.0
        own = own.select("_q", (F.col("w") / every).alias("share"))
        least = own.agg(F.min("share")).first()[0] or 1.0
        block_rounds = max(block_rounds, int(tokens / (least * length * MOST_TOTALS)) + 1)
    totals = totals.withColumn("before", F.coalesce(F.sum("total").over(earlier), F.lit(0))).join(own, F.col("queue") == F.col("_q"))
    totals = totals.select(F.col("queue").alias("_queue"), F.col("bucket").alias("_bucket"), "before", "share")
    run = Window.partitionBy("queue", "bucket").orderBy("h", "doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("in_bucket", F.sum("n").over(run)).join(totals, (F.col("queue") == F.col("_queue")) & (F.col("bucket") == F.col("_bucket")))
    sent = F.col("before") + F.col("in_bucket")
    d = d.withColumn("sent", sent).withColumn("round", F.ceil(sent / (F.col("share") * length)))
    d = d.withColumn("block", F.floor(F.col("round") / block_rounds)).select("row", "n", "queue", "sent", "round", "block")
    blocks = d.groupBy("block").agg(F.sum("n").alias("total"))
    over = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("block").alias("_block"), F.coalesce(F.sum("total").over(over), F.lit(0)).alias("start"))
    run = Window.partitionBy("block").orderBy("round", "queue", "sent").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("in_block", F.sum("n").over(run)).join(blocks, F.col("block") == F.col("_block"))
    return d.select("row", (F.col("start") + F.col("in_block") - F.col("n")).alias("position"))


def pack(docs: DataFrame, weights: dict | None = None, length: int = LENGTH, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, little-endian, four bytes each) of every piece."""
    ids = tokenized(docs.select("doc_id", "source", "text"), path or tokenizer_path(), end_id)
    rows = written(ids.withColumn("row", F.monotonically_increasing_id()), docs)
    at = positions(rows.select("row", "doc_id", "source", "n"), weights, length).withColumnRenamed("row", "_row")
    placed = rows.join(at, F.col("row") == F.col("_row")).select("doc_id", "n", "position", "ids")

    def batches(parts):
        for b in parts:
            out = []
            for doc, n, position, raw in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                raw = raw.as_buffer()
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4").tobytes()
                start = 0
                while start < n:
                    offset = (position + start) % length
                    k = min(n - start, length - offset)
                    out.append((doc, start, k, n, (position + start) // length, offset, wide[4 * start : 4 * (start + k)]))
                    start += k
            if out:
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [pa.int64()] * 6 + [pa.binary()], strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return placed.mapInArrow(batches, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op1_packing(spark, sf_dir):
    """op1's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    pieces = pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    return compact(pieces, docs)
