"""A hashed maximum-entropy language model with class-factored softmax.

The probability of a word given those before it is that of its class given hashed features of the
context (the word before, skips over one and two words, and the pair of words before), times that of
its branch in the class given the same features hashed with the class, times its share of the branch:

* Classes: the end of a text, the most frequent words (one each), and clusters of spelling: k-means
  over hashed letter pairs of frequent words, so that each string, seen or not, has a class.
* Branches of a cluster: its most frequent words, one each, and its other words by length.
* Both softmaxes have a table of weights for each feature, whose rows are found by hashing.
  They are trained by rounds of distributed gradient updates: in each round every task starts from the
  common weights, makes AdaGrad steps over its documents, and ships what its rows moved by; rows are
  then averaged over tasks by how often each has used them. Tables have more rows the more text there
  is, up to a bound that a broadcast can bear.
* The softmax of a word in its branch has the word alone as feature, whose solution is the smoothed
  share (c + 0.5) / (N + 0.5 (V + 1)) of the branch's training tokens; unseen words share the rest.

Counts of all words are a table. At most HEAD frequent words are broadcast with theirs; others meet
their counts in a join, so no vocabulary is held as a whole anywhere.

Defined cases: null and empty texts are their end token alone; without training documents all counts
are 0 and the class model is uniform; repeated rows get equal results; null ids count as the text ""
in choosing training documents.
"""

from __future__ import annotations

import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, crc_mod, partitions, table, written
from .textarrays import Words, flat, mixed, slices, utf8

#: Words that are broadcast with their counts; words of a class of their own; spelling clusters.
HEAD, SINGLES, CLUSTERS = 1 << 17, 7, 24
CLASSES = 1 + SINGLES + CLUSTERS
#: Branches of a cluster, and how many of them are words of their own.
BRANCHES, OWN = 32, 24
#: log2 of the rows of a feature's table, at least and at most, features, rounds of training, tokens of a gradient step (with the least rows), its rate.
ROW_BITS, MOST_ROW_BITS, FEATURES, ROUNDS, STEP, RATE = 13, 16, 4, 2, 30_000, 0.5
#: log2 of the bytes of training text for which the least rows are enough.
ROW_BYTES = 30
#: Letter-pair cells, words that k-means reads, words a task counts before it ships.
CELLS, CLUSTERED, COUNTED = 64, 8192, 300_000
#: Bytes of text that a training task reads at most where there are tasks enough for all cores.
TASK_BYTES, SEED = 1 << 30, 2
BLOCK_ROWS = 1024
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def spellings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A unit vector of hashed letter pairs for each word data[start:end], A-Z as a-z."""
    n = end - start + 1  # pairs, with a mark before and after the word
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)  # of the second letter
    low = _LOWER[data]
    second = np.where(at < end[of], low[np.minimum(at, max(0, len(data) - 1))], np.uint32(3))
    first = np.where(at > start[of], low[at - 1], np.uint32(2))
    cell = ((first * np.uint32(0x01000193) ^ second * np.uint32(0x9E3779B1)) * np.uint32(0x85EBCA6B)) >> np.uint32(26)
    v = np.sqrt(np.bincount(of * CELLS + cell, minlength=len(n) * CELLS).reshape(len(n), CELLS).astype(np.float32))
    return v / np.sqrt(n.astype(np.float32))[:, None]


def _spelled(words: list[bytes]) -> np.ndarray:
    data, offsets = flat(words)
    return spellings(data, offsets[:-1], offsets[1:])


def clustered(words: list[bytes], counts: np.ndarray, k: int = CLUSTERS, rounds: int = 15) -> np.ndarray:
    """Centres of spherical k-means over spellings, weighted by the root of the counts."""
    if not words:
        return np.zeros((k, CELLS), np.float32)
    v, w = _spelled(words), np.sqrt(counts)[:, None]
    random = np.random.default_rng(SEED)
    centres = v[[int(np.argmax(counts))]]
    while len(centres) < k:
        gap = np.maximum(0, 1 - (v @ centres.T).max(1)) * w[:, 0]
        centres = np.concatenate([centres, v[[int(random.choice(len(v), p=gap / gap.sum()))]] if gap.sum() > 0 else v[:1]])
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, (v * w).astype(np.float32))
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centres)
    return centres.astype(np.float32)


class Lexicon:
    """The head's words by their hashes, with class, branch and count of each; those of any other word by its spelling.

    Class and branch are one number, class * BRANCHES + branch.
    """

    def __init__(self, head: list[tuple[bytes, int]], centres: np.ndarray, end_count: int):
        self.centres, self.end_count = centres, end_count
        data, offsets = flat([w for w, _ in head])
        words = Words(data, offsets)
        h = words.hashes(lower=True)
        kind = self._clusters(data, words.start, words.end)
        # The head is in order of count: a cluster's first words have branches of their own.
        group = kind // BRANCHES
        order = np.argsort(group, kind="stable")
        start = np.searchsorted(group[order], group[order])
        rank = np.empty(len(kind), np.int64)
        rank[order] = np.arange(len(kind)) - start
        first = rank - np.bincount(group[:SINGLES], minlength=CLASSES)[group]  # words of a class of their own don't count
        kind = np.where(first < OWN, group * BRANCHES + np.maximum(first, 0), kind).astype(np.uint16)
        kind[:SINGLES] = (1 + np.arange(min(SINGLES, len(kind)))) * BRANCHES
        order = np.argsort(h)
        self.keys, self.kind, self.count = h[order], kind[order], np.array([c for _, c in head], np.int64)[order]

    def _clusters(self, data, start, end) -> np.ndarray:
        cluster = 1 + SINGLES + (spellings(data, start, end) @ self.centres.T).argmax(1)
        return (cluster * BRANCHES + OWN + np.minimum((end - start) // 2, BRANCHES - OWN - 1)).astype(np.uint16)

    def known(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and count of each word; the count is -1 beyond the head."""
        kind, count = np.zeros(len(h), np.uint16), np.full(len(h), -1, np.int64)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            kind[hit], count[hit] = self.kind[at[hit]], self.count[at[hit]]
        else:
            hit = np.zeros(len(h), bool)
        rest = np.flatnonzero(~hit)
        if len(rest):
            _, first, back = np.unique(h[rest], return_index=True, return_inverse=True)
            kind[rest] = self._clusters(data, start[rest[first]], end[rest[first]])[back]
        return kind, count


class Stream:
    """The tokens of some texts, words and ends, in order: class and branch, count, place in words (-1: an end), text, and hashes of contexts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon):
        self.words = words = Words(data, offsets)
        self.hashes = h = words.hashes(lower=True)
        self.sizes = np.diff(words.of) + 1
        n, texts = len(h) + len(offsets) - 1, len(offsets) - 1
        self.text = np.repeat(np.arange(texts), self.sizes)
        end = np.cumsum(self.sizes) - 1
        inner = np.ones(n, bool)
        inner[end] = False
        self.place = np.full(n, -1)
        self.place[inner] = np.arange(len(h))
        self.kind, self.count = np.zeros(n, np.uint16), np.full(n, lexicon.end_count, np.int64)
        self.kind[inner], self.count[inner] = lexicon.known(h, data, words.start, words.end)
        # Contexts stand in a row with three start marks before each text.
        row = np.zeros(n + 3 * texts, np.uint32)
        at = np.arange(n) + 3 * (self.text + 1)
        row[at[inner]] = (h >> np.uint64(32)).astype(np.uint32)
        self.contexts = contexts_of(row[at - 1], row[at - 2], row[at - 3])


def contexts_of(h1: np.ndarray, h2: np.ndarray, h3: np.ndarray) -> list[np.ndarray]:
    """A hash of each feature of contexts, from the hashes of the last, second and third last word."""
    return [h1, h2 ^ np.uint32(0x5BD1E995), h3 ^ np.uint32(0x1B873593), h1 * np.uint32(0x85EBCA6B) ^ h2 * np.uint32(0xC2B2AE35)]


def rows_of(contexts: list[np.ndarray], bits: int, group: np.ndarray | None = None) -> list[np.ndarray]:
    """The row of each feature's table, of the class softmax or, given the tokens' classes, of that of their branches."""
    shift, m = np.uint32(32 - bits), np.uint32(0x9E3779B1)
    turn = np.uint32(0) if group is None else group.astype(np.uint32) * np.uint32(0xCC9E2D51) + np.uint32(0x38495AB5)
    return [(((x ^ turn) * m) >> shift).astype(np.uint16) for x in contexts]


def scores_of(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Logits of the outcomes in each context, within bounds that exp() can take. bias: one row, or one for each context."""
    z = weights[0].take(rows[0], 0)
    for k in range(1, FEATURES):
        z += weights[k].take(rows[k], 0)
    z += bias
    return np.clip(z, -60, 60, out=z)


def log_shares(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], kind: np.ndarray) -> np.ndarray:
    """Log probability (natural) of one outcome in each context."""
    z = scores_of(weights, bias, rows)
    own = z[np.arange(len(kind)), kind]
    return own - np.log(np.exp(z, out=z).sum(1))


def log_probability(weights: np.ndarray, bias: np.ndarray, inner: np.ndarray, contexts: list[np.ndarray], kind: np.ndarray, bits: int) -> np.ndarray:
    """Log probability (natural) of the class and branch of each token in its context."""
    group = kind // BRANCHES
    out = log_shares(_half(weights, False), bias, rows_of(contexts, bits), group)
    many = np.flatnonzero(group > SINGLES)
    if len(many):
        g = group[many]
        out[many] += log_shares(_half(weights, True), inner[g], rows_of([c[many] for c in contexts], bits, g), kind[many] % BRANCHES)
    return out


class Trainer:
    """Gradient steps from some weights; used counts the tokens that each row has taken part in.

    Weights lie by class here, so that what a step adds to a class's rows is one weighted count.
    """

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.by_class, self.bias, self.rows = np.ascontiguousarray(weights.transpose(0, 2, 1)), bias[:, None], weights.shape[1]
        self.used = np.zeros(weights.shape[:2], np.int32)
        self.squares = np.full(weights.shape[:2], 1e-3)

    @property
    def weights(self) -> np.ndarray:
        return np.ascontiguousarray(self.by_class.transpose(0, 2, 1))

    def step(self, rows: list[np.ndarray], kind: np.ndarray, bias: np.ndarray | None = None) -> None:
        """One step over tokens; bias: outcomes x tokens, where it isn't the same for all."""
        z = self.by_class[0].take(rows[0], 1)
        for k in range(1, FEATURES):
            z += self.by_class[k].take(rows[k], 1)
        z += self.bias if bias is None else bias
        np.exp(np.clip(z, -60, 60, out=z), out=z)
        z *= -1 / z.sum(0)
        z[kind, np.arange(len(kind))] += 1
        gradient = z.astype(np.float64)
        for k, row in enumerate(rows):
            sums = np.stack([np.bincount(row, g, self.rows) for g in gradient])
            self.used[k] += np.bincount(row, minlength=self.rows).astype(np.int32)
            self.squares[k] += np.einsum("ij,ij->j", sums, sums)
            sums *= RATE / np.sqrt(self.squares[k])
            self.by_class[k] += sums


_LEXICONS: dict = {}


def _lexicon(shared) -> Lexicon:
    """The lexicon of a broadcast (head, centres, end count), one for each worker."""
    if shared.value[3] not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[shared.value[3]] = Lexicon(*shared.value[:3])
    return _LEXICONS[shared.value[3]]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over all of docs; without end tokens."""

    def counted(batches):
        counts: Counter = Counter()

        def shipped():
            return pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])

        for b in batches:
            data, offsets = utf8(b.column(0))
            for first, last in slices(offsets):
                # White space parts texts too: a slice's words are those of its texts if a blank stands between them.
                part = offsets[first : last + 1]
                raw = data[part[0] : part[-1]].tobytes().lower()
                part = (part - part[0]).tolist()
                counts.update(b" ".join([raw[i:j] for i, j in zip(part[:-1], part[1:], strict=True)]).split())
                if len(counts) > COUNTED:
                    yield shipped()
                    counts.clear()
        if counts:
            yield shipped()

    return docs.select(F.col("text").cast("string")).mapInArrow(counted, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _averaged(batches):
    """Moves of equal blocks of rows averaged by use: (block, move) with float32 values."""
    now = total = use = None

    def done():
        return pa.record_batch([pa.array([now], pa.int32()), pa.array([(total / np.maximum(use, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())], ["block", "move"])

    for b in batches:
        for block, move, used in zip(*(c.to_pylist() for c in b.columns), strict=True):
            n = np.frombuffer(used, np.int32).astype(np.float64)
            m = np.frombuffer(move, np.float16).reshape(len(n), -1).astype(np.float64) * n[:, None]
            if block == now:
                total, use = total + m, use + n
                continue
            if now is not None:
                yield done()
            now, total, use = block, m, n
    if now is not None:
        yield done()


def _half(weights: np.ndarray, branches: bool) -> np.ndarray:
    """The tables of the softmax over classes, or over branches."""
    return weights[FEATURES:] if branches else weights[:FEATURES]


def row_bits(volume: int) -> int:
    """log2 of the rows of a table for so many bytes of training text."""
    return min(MOST_ROW_BITS, max(ROW_BITS, ROW_BITS + max(volume, 1).bit_length() - ROW_BYTES))


def trained(docs: DataFrame, shared, bias: np.ndarray, inner: np.ndarray, volume: int, bits: int) -> np.ndarray:
    """Weights after ROUNDS rounds, each over its share of docs by a hash of the id and text: tables of both softmaxes, one after the other.

    bias: logits of the classes without a context; inner: of the branches of each class.
    """
    spark = docs.sparkSession
    weights = np.zeros((2 * FEATURES, 1 << bits, CLASSES), np.float32)
    tasks = max(spark.sparkContext.defaultParallelism, -(-volume // TASK_BYTES))
    parts, step = partitions(docs), STEP << (bits - ROW_BITS)
    for turn in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def moved(batches, start=start):
            lexicon = _lexicon(shared)
            outer, branches = Trainer(_half(start.value, False), bias), Trainer(_half(start.value, True), bias)
            held, n = [], 0

            def learn():
                contexts, kind = [np.concatenate([h[0][k] for h in held]) for k in range(FEATURES)], np.concatenate([h[1] for h in held])
                whole = len(kind) // step * step or len(kind)
                for i in range(0, whole, step):
                    part, own = [c[i : i + step] for c in contexts], kind[i : i + step]
                    group = own // BRANCHES
                    outer.step(rows_of(part, bits), group)
                    many = np.flatnonzero(group > SINGLES)
                    if len(many):
                        g = group[many]
                        branches.step(rows_of([c[many] for c in part], bits, g), own[many] % BRANCHES, np.ascontiguousarray(inner[g].T))
                return [([c[whole:] for c in contexts], kind[whole:])]

            for b in batches:
                data, offsets = utf8(b.column(0))
                for first, last in slices(offsets):
                    part = offsets[first : last + 1]
                    stream = Stream(data[part[0] : part[-1]], part - part[0], lexicon)
                    held.append((stream.contexts, stream.kind))
                    n += len(stream.kind)
                    if n >= step:
                        held = learn()
                        n = len(held[0][1])
            if n:
                learn()
            move = (np.concatenate([outer.weights, branches.weights]) - start.value).reshape(-1, BLOCK_ROWS, CLASSES)
            used = np.concatenate([outer.used, branches.used]).reshape(-1, BLOCK_ROWS)
            for block in np.flatnonzero(used.any(1)).tolist():
                yield pa.record_batch([pa.array([block], pa.int32()), pa.array([move[block].astype(np.float16).tobytes()], pa.binary()), pa.array([used[block].tobytes()], pa.binary())], ["block", "move", "used"])

        share = docs.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", F.length("text")), F.lit(ROUNDS)) == turn).select(F.col("text").cast("string"))
        moves = share.coalesce(tasks).mapInArrow(moved, "block int, move binary, used binary")
        moves = moves.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_averaged, "block int, move binary")
        blocks = weights.reshape(-1, BLOCK_ROWS, CLASSES)
        for r in moves.toLocalIterator():
            blocks[r.block] += np.frombuffer(bytes(r.move), np.float32).reshape(BLOCK_ROWS, CLASSES)
        start.unpersist()
    return weights


def score(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    held_out: a condition; the model learns from rows where it is false.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    training = docs.where(~F.col("held_out"))
    ends, volume = training.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    vocabulary = written(word_counts(training), docs)
    words, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, distinct = words + ends, distinct + (ends > 0)

    # The head: all words of at least so many occurrences as leave HEAD of them at most.
    least, n = 1 << 62, 0
    frequent = vocabulary.where("c >= 256").groupBy("c").count().orderBy(F.desc("c")).limit(HEAD)
    every = [frequent, vocabulary.where("c < 256").groupBy("c").count().orderBy(F.desc("c")).limit(256)]
    for c, k in (r for part in every for r in part.collect()):
        if n + k > HEAD:
            break
        least, n = c, n + k
    head = sorted(((r.c, r.word.encode()) for r in vocabulary.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    head = [(w, c) for c, w in head]
    centres = clustered([w for w, _ in head[:CLUSTERED]], np.array([c for _, c in head[:CLUSTERED]], float))
    shared = sc.broadcast((head, centres, ends, uuid.uuid4().hex))

    def sized(batches):
        sums = np.zeros((CLASSES * BRANCHES, 2), np.int64)
        lexicon = _lexicon(shared)
        for b in batches:
            data, offsets = utf8(b.column(0))
            words = Words(data, offsets)
            kind, c = lexicon.known(words.hashes(lower=True), data, words.start, words.end)[0], b.column(1).to_numpy()
            sums[:, 0] += np.bincount(kind, c, len(sums)).astype(np.int64)
            sums[:, 1] += np.bincount(kind, minlength=len(sums))
        yield pa.record_batch([pa.array(range(len(sums)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["kind", "n", "v"])

    sizes = np.zeros((CLASSES * BRANCHES, 2), np.int64)
    for r in vocabulary.select("word", "c").mapInArrow(sized, "kind int, n long, v long").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        sizes[r.kind] = r.n, r.v
    sizes[0] = ends, ends > 0
    groups = sizes[:, 0].reshape(CLASSES, BRANCHES)
    bias = np.log((groups.sum(1) + 0.5) / (groups.sum() + 0.5 * CLASSES)).astype(np.float32)
    # A branch that is one word's has no room for others; the branches by length are open to any word.
    open_ = np.concatenate([np.zeros(OWN), np.full(BRANCHES - OWN, 0.5)])
    inner = np.log(np.maximum(groups + open_, 1e-9) / np.maximum(groups + open_, 1e-9).sum(1, keepdims=True)).astype(np.float32)
    inner = np.maximum(inner, np.float32(-30))
    bits = row_bits(volume)
    weights = sc.broadcast(trained(training, shared, bias, inner, volume, bits))
    # In a class or branch of one word, which no other string falls into, the word is certain.
    room = np.log10(sizes[:, 0] + 0.5 * (sizes[:, 1] + 1))
    at = np.arange(len(sizes))
    alone = (at // BRANCHES <= SINGLES) | (at % BRANCHES < OWN)
    base_room = float(np.log10(total + 0.5 * (distinct + 1)))

    def scored(batches):
        lexicon = _lexicon(shared)
        for b in batches:
            data, offsets = utf8(b.column(1))
            row = b.column(3).to_numpy()
            out, rest = [], []
            for first, last in slices(offsets):
                part = offsets[first : last + 1]
                local = data[part[0] : part[-1]]
                stream = Stream(local, part - part[0], lexicon)
                kind, count, n = stream.kind, stream.count, stream.sizes
                logs = np.concatenate([log_probability(weights.value, bias, inner, [c[i : i + STEP] for c in stream.contexts], kind[i : i + STEP], bits) for i in range(0, len(kind), STEP)])
                seen = count >= 0  # ends always
                value = np.log10(np.where(seen, count, 0) + 0.5)
                within = np.where(alone[kind], 0.0, value - room[kind])
                edge = np.cumsum(n) - n
                sums = [np.add.reduceat(x, edge) for x in (np.where(seen, within, 0) + logs / np.log(10), np.where(seen, value - base_room, 0), (count > 0).astype(np.int64))]
                out.append((n, *sums))
                # Tail words of a document, each once.
                tail = np.flatnonzero(~seen)
                place, text = stream.place[tail], stream.text[tail]
                _, once, times = np.unique(stream.hashes[place] + mixed(text.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
                place = place[once]
                raw = local.tobytes().lower()
                words = pa.array([raw[i:j] for i, j in zip(stream.words.start[place].tolist(), stream.words.end[place].tolist(), strict=True)], pa.binary()).cast(pa.string())
                rest.append((row[first + text[once]], words, times, room[kind[tail[once]]]))
            if not out:
                continue
            n, s, base, known = (np.concatenate(x) for x in zip(*out, strict=True))
            rows, words, times, rooms = zip(*rest, strict=True)
            m, k = sum(map(len, rows)), b.num_rows
            zero, none = np.zeros(m), np.zeros(k, np.int64)
            columns = [
                pa.array(np.concatenate([row, *rows])), pa.concat_arrays([b.column(0), pa.nulls(m, pa.int64())]), pa.concat_arrays([b.column(2), pa.nulls(m, pa.bool_())]),
                pa.concat_arrays([pa.array(n), pa.nulls(m, pa.int64())]), pa.array(np.concatenate([known, zero.astype(np.int64)])), pa.array(np.concatenate([base, zero])), pa.array(np.concatenate([s, zero])),
                pa.concat_arrays([pa.nulls(k, pa.string()), *words]), pa.array(np.concatenate([none, *times])), pa.array(np.concatenate([np.zeros(k), *rooms])),
            ]
            yield pa.record_batch(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "f", "room"])

    shape = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word string, f long, room double"
    parts = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(scored, shape), docs)
    tail = parts.where("word is not null").select("row", "word", "f", "room").join(vocabulary.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    value = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    tail = tail.select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("long").alias("n_tokens"), F.when(F.col("c") > 0, F.col("f")).otherwise(0).alias("n_known"), (F.col("f") * (value - base_room)).alias("base"), (F.col("f") * (value - F.col("room"))).alias("score"))
    both = parts.where("word is null").select(*tail.columns).unionAll(tail).groupBy("row").agg(*(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")), *(F.sum(c).alias(c) for c in ("n_known", "base", "score")))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def op2_maxent(spark, sf_dir):
    """op2's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compact(score(docs, crc_mod("doc_id", 5) == 1), docs)
