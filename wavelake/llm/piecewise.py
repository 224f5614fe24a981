"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a chunk wherever it is one less than a multiple of the
block size, the least power of two that a text of its length has at most MOST times. So that texts
that repeat themselves have chunks as well, one is at least a quarter of the block size and at most
four of it long. Each chunk, with the OVERLAP bytes before it, gives a 12-bit code, written as two
letters. A fingerprint is `block size:codes:codes at twice the block size`; of MOST chunks the last
one holds all the rest of the text. Fingerprints of equal block size, or of one and its double, are compared by the edit
distance of their codes (insertions and deletions cost 1, a replacement 2) as
1 - distance / (both lengths); others are 0 alike, equal ones 1.

Defined cases: null is the empty text, fingerprint "1::"; equal texts have equal fingerprints;
the next document follows by doc_id (nulls first), ties by a hash of the text; a single row is its own next;
no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, partitions, table, text_of, written
from .textarrays import BYTE_BASE, _byte_values, mixed, packed, powers, unpacked

WINDOW, OVERLAP, MOST = 7, 2, 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = np.uint32(0x01000193)


class Prints:
    """Fingerprints of some texts: block sizes, and code matrices (texts x MOST, -1 where there is none) at one and two block sizes."""

    def __init__(self, block: np.ndarray, one: np.ndarray, two: np.ndarray):
        self.block, self.codes = block, (one, two)

    def take(self, index) -> Prints:
        return Prints(self.block[index], *(c[index] for c in self.codes))

    def strings(self) -> list[str]:
        written_ = []
        for c in self.codes:
            letters = np.stack([_LETTERS[(c >> 6) & 63], _LETTERS[c & 63]], 2).reshape(len(c), -1).tobytes()
            n, width = (c >= 0).sum(1), 4 * MOST // 2
            written_.append([letters[i * width : i * width + 2 * k].decode() for i, k in enumerate(n.tolist())])
        return [f"{b}:{x}:{y}" for b, x, y in zip(self.block.tolist(), *written_, strict=True)]

    @staticmethod
    def joined(parts: list[Prints]) -> Prints:
        return Prints(np.concatenate([p.block for p in parts]), *(np.concatenate([p.codes[k] for p in parts]) for k in (0, 1)))


def _codes(data_sums, inverse, roll, start, end, block) -> np.ndarray:
    """The codes of each text at its block size: a step finds the next chunk of all texts."""
    text = np.repeat(np.arange(len(start)), end - start)
    at = np.arange(len(text)) + np.repeat(start - np.concatenate([[0], np.cumsum(end - start)[:-1]]), end - start)
    low = (block - 1).astype(np.uint32)[text]
    hits = np.append(at[roll[at] & low == low], np.iinfo(np.int64).max)
    least, most = np.maximum(1, block // 4), 4 * block
    out = np.full((len(start), MOST), -1, np.int16)
    begin, open_ = start.copy(), np.flatnonzero(start < end)
    for k in range(MOST):
        if not len(open_):
            break
        a, z = begin[open_], end[open_]
        stop = z
        if k < MOST - 1:
            stop = np.minimum(np.minimum(hits[np.searchsorted(hits, a + least[open_] - 1)], a + most[open_] - 1) + 1, z)
        h = mixed((data_sums[stop] - data_sums[a - OVERLAP]) * inverse[a - OVERLAP] + (stop - a).astype(np.uint64))
        out[open_, k] = (h >> np.uint64(52)).astype(np.int16)
        begin[open_] = stop
        open_ = open_[stop < z]
    return out


def _prints(texts: list[bytes]) -> Prints:
    gap = bytes(WINDOW)
    data = np.frombuffer(gap + gap.join(texts), np.uint8)
    n = np.array([len(x) for x in texts])
    end = np.cumsum(n + WINDOW)
    start = end - n
    roll = np.zeros(len(data), np.uint32)
    part = np.zeros(max(0, len(data) - WINDOW + 1), np.uint32)
    for k in range(WINDOW):
        part *= _ROLL
        part += data[k : len(data) - WINDOW + 1 + k]
    part ^= part >> np.uint32(15)
    part *= np.uint32(0x2C1B3C6D)
    part ^= part >> np.uint32(13)
    roll[WINDOW - 1 :] = part
    block = 2 ** np.ceil(np.log2(np.maximum(n / MOST, 1))).astype(np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values(False)[data] * powers(BYTE_BASE, len(data)), dtype=np.uint64)])
    inverse = powers(pow(BYTE_BASE, -1, 1 << 64), len(data) + 1)
    return Prints(block, *(_codes(sums, inverse, roll, start, end, b) for b in (block, 2 * block)))


def prints(texts: list[bytes]) -> Prints:
    parts, held, n = [], [], 0
    for x in texts:
        if held and n + len(x) > SLICE_BYTES:
            parts.append(_prints(held))
            held, n = [], 0
        held.append(x)
        n += len(x) + WINDOW
    if held or not parts:
        parts.append(_prints(held))
    return Prints.joined(parts)


def _similar(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """2 * longest common subsequence / both lengths of each pair of code rows, 64 steps in bit-parallel form."""
    y = np.where(y < 0, np.int16(-2), y)
    v = np.full(len(x), ~np.uint64(0))
    for j in range(MOST):
        match = np.packbits(x == y[:, j : j + 1], axis=1, bitorder="little").view(np.uint64)[:, 0]
        u = v & match
        v = (v + u) | (v - u)
    common = np.bitwise_count(~v).astype(float)
    total = (x >= 0).sum(1) + (y >= 0).sum(1)
    return 2 * common / np.maximum(total, 1)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """0 to 1 for each pair of fingerprints."""
    out = np.zeros(len(a.block))
    for at, sides in ((a.block == b.block, ((0, 0), (1, 1))), (a.block == 2 * b.block, ((0, 1),)), (2 * a.block == b.block, ((1, 0),))):
        at = np.flatnonzero(at)
        for i, j in sides if len(at) else ():
            out[at] = np.maximum(out[at], _similar(a.codes[i][at], b.codes[j][at]))
    same = (a.block == b.block) & (a.codes[0] == b.codes[0]).all(1) & (a.codes[1] == b.codes[1]).all(1)
    out[same] = 1.0
    return out


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of what follows."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def _compared(ids: list, texts: list[str], own: Prints, following: list[str], after: Prints) -> list[list]:
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    new = prints(changed)
    return [ids, [len(x) for x in texts], [hashlib.sha256(x).hexdigest() for x in changed], own.strings(), new.strings(), likeness(own, new), likeness(own, after)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are dealt out in ranges of doc_id, once; each task compares its rows with their next ones
    and hands on its first and last row, which are matched across tasks afterwards.
    """
    parts = partitions(docs)
    texts = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.xxhash64("text").alias("tie"))
    ranged = packed(texts, "text", "frame").repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def swept(batches):
        held = first = None
        part = TaskContext.get().partitionId()

        def rows(columns, kind, text):
            n = len(columns[0])
            return pa.record_batch([*(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)), pa.array([kind] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array([text] * n, pa.string())], [*_NAMES, "kind", "part", "text"])

        def edge(kind, row):
            return rows([[row[0]], *([None] for _ in _NAMES[1:])], kind, row[1])

        for b in batches:
            all_ids = b.column(0).to_pylist()
            for a, z, raw in unpacked(b.column(2), 8 * SLICE_BYTES):
                ids, text, own = all_ids[a:z], [x.decode() for x in raw], prints(raw)
                if first is None:
                    first = (ids[0], text[0])
                    yield edge(1, first)
                if held is not None:
                    ids, text, own = [held[0], *ids], [held[1], *text], Prints.joined([held[2], own])
                if len(ids) > 1:
                    yield rows(_compared(ids[:-1], text[:-1], own.take(slice(0, -1)), text[1:], own.take(slice(1, None))), 0, None)
                held = (ids[-1], text[-1], own.take(slice(-1, None)))
        if held is not None:
            yield edge(2, held)

    # Not in fewer files: a task's number is its place in the order of ranges.
    found = written(ranged.mapInArrow(swept, f"{_OUT}, kind int, part int, text string"))
    # A row for each task that had any.
    order = Window.orderBy("part")
    nexts = found.where("kind = 1").select("part", "text")
    ring = nexts.select("part").withColumn("_next", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())))
    lasts = found.where("kind = 2").select("doc_id", "part", "text").join(ring, "part").join(nexts.select(F.col("part").alias("_next"), F.col("text").alias("after")), "_next")

    def matched(batches):
        for b in batches:
            ids, text, after = (b.column(k).to_pylist() for k in range(3))
            columns = _compared(ids, text, prints([x.encode() for x in text]), after, prints([x.encode() for x in after]))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    return found.where("kind = 0").select(*_NAMES).unionAll(lasts.select("doc_id", "text", "after").mapInArrow(matched, _OUT))


def op3_piecewise(spark, sf_dir):
    """op3's digest over the whole documents table."""
    return fingerprints(table(spark, sf_dir, "documents"))
