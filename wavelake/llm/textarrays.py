"""Vectorised word and window hashes over the UTF-8 buffer of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import SLICE_BYTES

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M64 = (1 << 64) - 1
#: Odd multipliers of the polynomial hashes: of bytes in a word, and two of words in a window.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(8)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1 << 16, 1 << (n + 1).bit_length()))[:n]


@lru_cache(2)
def _byte_values(lower: bool) -> np.ndarray:
    values = mixed(np.arange(1, 257, dtype=np.uint64))
    if lower:
        values[65:91] = values[97:123]
    return values


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit bytes together, or of one longer text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """Words of some texts: byte ranges start/end, and of[i]:of[i + 1] are those of text i.

    cut: two tables of bytes; a word is also cut where one of the second follows one of the first.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, cut: tuple[np.ndarray, np.ndarray] | None = None):
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if cut is not None:
            edge[1:n] |= cut[0][data[:-1]] & cut[1][data[1:]]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        before[:-1] = inside[1:]  # now: whether the byte after is inside
        before[-1:] = False
        self.end = np.flatnonzero(inside & (~before | edge[1:])) + 1
        self.of = np.searchsorted(self.start, offsets)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; lower: A-Z count as a-z."""
        return span_hashes(self.data, self.start, self.end, lower)

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words at which a window of so many words of one text starts."""
        last = np.zeros(len(self.start) + 1, np.int8)  # words with less than a window after them
        np.add.at(last, np.maximum(self.of[1:] - (size - 1), self.of[:-1]), 1)
        np.subtract.at(last, self.of[1:], 1)
        return np.flatnonzero(np.cumsum(last[:-1], dtype=np.int8) == 0)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each data[start:end], spans in order and apart.

    The polynomial starts anew after every SLICE_BYTES, so that a long text needs no more memory for
    it than a short one; a hash doesn't depend on where that is.
    """
    out, values = np.empty(len(start), np.uint64), _byte_values(lower)
    inverse, i = pow(BYTE_BASE, -1, 1 << 64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, "right")))
        a, z = int(start[i]), int(end[j - 1])
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(values[data[a:z]] * powers(BYTE_BASE, z - a), out=sums[1:])
        first, last = start[i:j] - a, end[i:j] - a
        out[i:j] = mixed((sums[last] - sums[first]) * powers(inverse, z - a + 1)[first] + (last - first).astype(np.uint64))
        i = j
    return out


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """A 64-bit hash of words[i : i + size] for each i in at, which ascends. In slices, as span_hashes()."""
    out, inverse, i = np.empty(len(at), np.uint64), pow(base, -1, 1 << 64), 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + SLICE_BYTES // 4, "right"))
        a, z = int(at[i]), int(at[j - 1]) + size
        sums = np.zeros(z - a + 1, np.uint64)
        np.cumsum(words[a:z] * powers(base, z - a), out=sums[1:])
        k = at[i:j] - a
        out[i:j] = mixed((sums[k + size] - sums[k]) * powers(inverse, z - a + 1)[k])
        i = j
    return out


def packed(docs: DataFrame, text: str, to: str) -> DataFrame:
    """docs with the text column replaced, as the last one, by its UTF-8 bytes as zstandard frames (null: of the empty text).

    For texts that are about to be shuffled: a frame for each text takes half of what Spark's own block compression leaves.
    """
    at = docs.columns.index(text)
    fields = [f for f in docs.schema.fields if f.name != text]

    def batches(rows):
        press = zstandard.ZstdCompressor(level=1)
        for b in rows:
            data, offsets = utf8(b.column(at))
            raw = memoryview(data)
            frames = [press.compress(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch([*(c for k, c in enumerate(b.columns) if k != at), pa.array(frames, pa.binary())], [*(f.name for f in fields), to])

    return docs.mapInArrow(batches, T.StructType([*fields, T.StructField(to, T.BinaryType())]))


def unpacked(frames: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last, texts) of ranges of texts of at most limit bytes together, or of one longer text."""
    press = zstandard.ZstdDecompressor()
    first, held, n = 0, [], 0
    for k, frame in enumerate(frames):
        text = press.decompress(frame.as_buffer())
        if held and n + len(text) > limit:
            yield first, k, held
            first, held, n = k, [], 0
        held.append(text)
        n += len(text)
    if held:
        yield first, first + len(held), held


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts and the offsets of each."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum([len(x) for x in texts], dtype=np.int64)])
