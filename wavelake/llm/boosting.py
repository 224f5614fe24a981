"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are taken in vectorised batches on the executors. The model is fitted on
the driver from the statistics of at most SAMPLE labelled documents (chosen by a seeded hash of the
id), and is small: complete binary trees flattened into arrays, which each batch is led through
level by level.

Defined cases: null and empty texts have the statistics of the empty text and get its score; labels
that are null are left out, and of several labels of a document the mean counts (half is good);
without labelled rows every score is 0.5, with one class only its share; repeated rows get equal
scores; ids without a document are left out of the fit, and of rows that share an id one is read (the
least by its statistics).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, compact, crc_mod, table
from .compression import _again, _sums, duplicate_lines, repeated_words
from .textarrays import Words, mixed, slices, utf8

#: Labelled documents that the fit reads at most, and the seed of their choice.
SAMPLE, SEED = 20_000, 8
TREES, DEPTH, RATE, BINS, LEAST_HESSIAN, SHRINK = 80, 4, 0.15, 64, 4.0, 1.0
#: Documents of this score or more are good.
THRESHOLD = 0.3

_CLASSES = {
    "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "stop": b".?", "bang": b"!", "comma": b",;:", "bar": b"|",
    "symbol": b"#*$%&<>@^~=+_\\", "bracket": b"()[]{}", "quote": b"\"'`", "slash": b"/-", "newline": b"\n", "other": bytes(range(128, 256)),
}
FEATURES = ["log_bytes", "log_words", "word_bytes", "log_longest", *(f"{k}_share" for k in _CLASSES), "short_words", "long_words", "words_a_line", "bare_ends", "stop_words_a_stop", "repeated_word_share", "repeated_phrase_share", "duplicate_line_share"]


def statistics(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, as float32."""
    data, offsets = utf8(column)
    out = [np.zeros((0, len(FEATURES)), np.float32)]
    table_ = np.zeros(256, np.uint8)
    for k, members in enumerate(_CLASSES.values()):
        table_[list(members)] = k + 1
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        local, part = data[part[0] : part[-1]], part - part[0]
        words = Words(local, part)
        h = words.hashes()
        n_words = np.maximum(np.diff(words.of), 1).astype(float)
        n_bytes = np.diff(part).astype(float)
        length = words.end - words.start
        total = np.add.reduceat(np.append(length, 0), words.of[:-1]) * (np.diff(words.of) > 0)
        longest = np.maximum.reduceat(np.append(length, 0), words.of[:-1]) * (np.diff(words.of) > 0)
        of_word = np.repeat(np.arange(len(n_words)), np.diff(words.of))
        kinds = table_[local]
        # Texts' counts of kinds of bytes; a long text is counted in slices.
        counts, wide = np.zeros((len(n_words), len(_CLASSES) + 1), np.int64), len(_CLASSES) + 1
        for a in range(0, len(local), SLICE_BYTES):
            z = min(a + SLICE_BYTES, len(local))
            i, j = np.searchsorted(part, a, "right") - 1, np.searchsorted(part, z, "left")
            key = np.repeat(np.arange(j - i), np.diff(np.clip(part[i : j + 1], a, z))) * wide + kinds[a:z]
            counts[i:j] += np.bincount(key, minlength=(j - i) * wide).reshape(j - i, wide)
        counts = counts[:, 1:]
        shares = counts / np.maximum(n_bytes, 1)[:, None]
        lines = counts[:, list(_CLASSES).index("newline")] + 1.0
        ends = kinds[words.end - 1] if len(words.end) else np.zeros(0, int)
        bare = _sums(ends == 0, words.of) / n_words
        again = _again(h + mixed(of_word.astype(np.uint64) + np.uint64(1)))
        rows = [
            np.log1p(n_bytes), np.log1p(np.diff(words.of)), total / n_words, np.log1p(longest), *shares.T,
            _sums(length <= 3, words.of) / n_words, _sums(length >= 14, words.of) / n_words, n_words / lines, bare,
            n_words / (counts[:, list(_CLASSES).index("stop")] + 1.0), _sums(again, words.of) / n_words,
            _sums(repeated_words(words, h), words.of) / n_words, duplicate_lines(local, part, words) / lines,
        ]
        out.append(np.stack(rows, 1).astype(np.float32))
    return np.concatenate(out)


@dataclass
class Forest:
    """Complete trees: node i has children 2 i + 1 and 2 i + 2; a value above the threshold goes to the second."""

    base: float
    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH if len(feature) else 0):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Forest:
    """Boosted trees for labels y (0 to 1) by second-order steps on the logistic loss."""
    nodes = 2**DEPTH - 1
    none = Forest(0.0, np.zeros((0, nodes), int), np.zeros((0, nodes), np.float32), np.zeros((0, nodes + 1)))
    if not len(y):
        return none
    share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    none.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return none
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(width)], 1)
    total, trees = np.full(n, none.base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, threshold = np.zeros(nodes, int), np.full(nodes, np.inf, np.float32)
        at = np.zeros(n, int)
        for level in range(DEPTH):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            cut = np.full(count, BINS)
            for j in range(width):
                key = (at - first) * BINS + binned[:, j]
                gs, hs = (np.bincount(key, w, count * BINS).reshape(count, BINS).cumsum(1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + SHRINK) + (gt - gs) ** 2 / (ht - hs + SHRINK) - gt**2 / (ht + SHRINK)
                gain[(hs < LEAST_HESSIAN) | (ht - hs < LEAST_HESSIAN)] = 0
                k = gain[:, : len(edges[j])].argmax(1) if len(edges[j]) else np.zeros(count, int)
                top = gain[np.arange(count), k]
                better = top > best
                best[better], cut[better] = top[better], k[better]
                feature[first : first + count][better] = j
                threshold[first : first + count][better] = edges[j][k[better]] if len(edges[j]) else np.inf
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > threshold[at])
        at -= nodes
        leaf = RATE * np.bincount(at, g, nodes + 1) / (np.bincount(at, h, nodes + 1) + SHRINK)
        total += leaf[at]
        trees.append((feature, threshold, leaf))
    return Forest(none.base, *(np.stack(k) for k in zip(*trees, strict=True)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A Forest fitted on labelled documents whose crc32 of the id is not a multiple of 5."""
    labels = labels.where("quality is not null and doc_id is not null").where(crc_mod("doc_id", 5) != 0)
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("_label_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("_label"))
    chosen = labels.orderBy(F.xxhash64(F.lit(SEED), "_label_id"), "_label_id").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_label_id"))

    def batches(rows):
        for b in rows:
            x = statistics(b.column(2)).astype(np.float32)
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    # One row for each chosen id, whatever rows share it: at most `sample` rows reach the driver.
    rows = joined.select("doc_id", "_label", "text").mapInArrow(batches, "id long, label double, x binary").groupBy("id", "label").agg(F.min("x").alias("x")).collect()
    rows = sorted((r.id, bytes(r.x), r.label) for r in rows)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r[2] for r in rows]))


def scored(docs: DataFrame, model: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def batches(rows):
        for b in rows:
            s = model.scores(statistics(b.column(2)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def op8_boosting(spark, sf_dir):
    """op8's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    return compact(scored(docs, train(docs, table(spark, sf_dir, "labels"))), docs)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that a model fitted on docs and labels does not reject, with all their columns.

    Rows are judged by their text alone: null and empty texts as the empty text, equal texts alike,
    whatever their ids; without labels all score 0.5 and stay; an empty table gives no rows.
    """
    model, at = train(docs, labels), docs.columns.index("text")

    def batches(rows):
        for b in rows:
            yield b.filter(pa.array(model.scores(statistics(b.column(at).cast(pa.string()))) >= THRESHOLD))

    return docs.mapInArrow(batches, docs.schema)
