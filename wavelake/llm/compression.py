"""Quality rules on text structure and compression bands.

A text passes the bands if its zstandard ratio (bytes / compressed bytes) lies between two limits
that depend on its length, and if the fixed chunks that hold most of it do so: full ones by limits of
their own, the rest of the text, which is the last chunk, by those of a text of its length. High ratios
mean repetition, low ones noise. Short texts compress less, so limits rise with the length; those
below the least length have none. Base rules fail texts of few words or of mostly repeated phrases.

Defined cases: null and empty texts have no words and fail; a text is judged on its own, so repeated
rows get equal results; very long texts are compressed whole and in all their chunks; a text below the
size of a chunk is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, table
from .textarrays import Words, mixed, slices, span_hashes, utf8, window_hashes

LEVEL, CHUNK = 3, 4096
#: (from bytes, least ratio, largest ratio) of whole texts; the last entry that a text reaches holds.
#: They leave some 5 % beyond the extremes seen among documents labelled good.
BANDS = ((256, 1.2, 2.1), (512, 1.35, 2.15), (1024, 1.5, 2.25), (2048, 1.7, 2.35), (4096, 1.85, 2.5), (16384, 2.0, 2.7), (65536, 2.0, 2.95))
#: The same of full chunks; a text fails if over CHUNK_SHARE of its bytes are in chunks that lie outside.
CHUNK_BAND, CHUNK_SHARE = (1.7, 2.45), 0.5
SYMBOLS = b"#*$%&|<>"
#: Words below which a text fails, and the share (of 100) of words in repeated phrases above which it does.
LEAST_WORDS, MOST_REPEATED = 50, 50
PHRASE = 3

COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "ratio": pa.float64(), "n_chunks": pa.int64(), "n_chunks_outside": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_()}
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_chunks_outside long, base_failed boolean, kept boolean"


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _again(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key


def repeated_words(words: Words, h: np.ndarray, size: int = PHRASE) -> np.ndarray:
    """Which words stand in a window of so many words that occurs twice or more in their text."""
    at = words.windows(size)
    of = np.searchsorted(words.of, at, "right") - 1
    again = at[_again(window_hashes(h, at, size) + mixed(of.astype(np.uint64) + np.uint64(1)))]
    cover = np.zeros(len(h) + 1, np.int32)
    for k in range(size):
        cover[again + k] = 1
    return cover[:-1] > 0


def duplicate_lines(data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    """For each text, the lines with a word that equal an earlier line of it."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:] |= data == 0x0A
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    end = end - ((end > start) & (data[end - 1] == 0x0A)) if n else end
    has = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
    start, end = start[has], end[has]
    of = np.searchsorted(offsets, start, "right") - 1
    key = span_hashes(data, start, end) + mixed(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    later = np.zeros(len(key), bool)
    later[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(of[later], minlength=len(offsets) - 1)


def _limits(n: int) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, a, b in BANDS:
        if n >= least:
            low, high = a, b
    return low, high


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """COLUMNS of each text."""
    data, offsets = utf8(column)
    found: dict[str, list] = {k: [] for k in COLUMNS}
    press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        local, part = data[part[0] : part[-1]], part - part[0]
        words = Words(local, part)
        h = words.hashes()
        chars = np.concatenate([np.zeros(1, np.int32), np.cumsum((local & 0xC0) != 0x80, dtype=np.int32)])
        word_chars = np.diff(np.concatenate([[0], np.cumsum(chars[words.end] - chars[words.start], dtype=np.int64)])[words.of])
        n_words = np.diff(words.of)
        n_repeat = _sums(repeated_words(words, h), words.of)
        ratio, n_chunks, outside, inside = [], [], [], []
        raw = memoryview(local)
        for a, b in zip(part[:-1].tolist(), part[1:].tolist(), strict=True):
            n = b - a
            r = n / len(press.compress(raw[a:b])) if n else 0.0
            low, high = _limits(n)
            bad = lost = 0
            for k in range(a, b, CHUNK):
                size = min(CHUNK, b - k)
                c = size / len(press.compress(raw[k : k + size]))
                least, most = CHUNK_BAND if size == CHUNK else _limits(size)
                if not least <= c <= most:
                    bad, lost = bad + 1, lost + size
            ratio.append(r)
            n_chunks.append(-(-n // CHUNK))
            outside.append(bad)
            inside.append(low <= r <= high and lost <= CHUNK_SHARE * n)
        failed = (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)
        new = (n_words, word_chars, _sums(symbol[local], part), duplicate_lines(local, part, words), n_repeat, ratio, n_chunks, outside, failed, np.array(inside, bool) & ~failed)
        for k, v in zip(COLUMNS, new, strict=True):
            found[k].append(np.asarray(v))
    return {k: np.concatenate(v) if v else np.zeros(0, COLUMNS[k].to_pandas_dtype()) for k, v in found.items()}


def judge(docs: DataFrame) -> DataFrame:
    """doc_id with COLUMNS, a row for each of docs."""

    def batches(rows):
        for b in rows:
            s = statistics(b.column(1))
            yield pa.record_batch([b.column(0), *(pa.array(s[k], t) for k, t in COLUMNS.items())], ["doc_id", *COLUMNS])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, f"doc_id long, {SCHEMA}")


def op6_compression(spark, sf_dir):
    """op6's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    return compact(judge(docs), docs)
