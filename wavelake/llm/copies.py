"""One document of each group of near-duplicates: texts whose five-word shingles are alike to 0.8 or more.

Each distinct text has a SimHash fingerprint and HASHES least hashes of its shingles. It is dealt out
once for each of BANDS bands, by two of its least hashes: texts of similarity s agree on both with
probability s * s, so of texts alike to 0.8 one pair in 30,000 meets in no band (and groups of copies
have many pairs). Rows are sorted by band and hashes, in ranges, so a task reads groups as runs; a run
beyond `group_rows` is parted by the next least hashes, which copies share too, and at last by
fingerprint, each part with the run's first row.

Within a group a binary trie over the fingerprints is walked as pairs of nodes that share an error
budget (see simhash). The budget rises in STEPS, so that each text is linked first to those nearest to it,
and links are those that join something new: m texts yield m - 1 of them. As the nearest by fingerprint
need not be alike, FORESTS such forests without a common link are taken from each group. The last step
lets 99.9 % of pairs alike to 0.8 through. What is found is held against the shingles themselves: a link
stays if the texts share at least 0.8 of all their different shingles. Groups are the components of links.

So far a text whose few links all fail is lost, and so is a link between parts of a run. Therefore texts
of a run that are of unlike groups by then are compared once more: each with the one that its sketch is nearest to,
and at last all pairs that are near by fingerprint and may be alike by their sketches (see blocks). No
link between texts that share a band and are near is lost, however large a run is.

Defined cases: A-Z count as a-z; shingles are sets; fewer words than a shingle's make one shingle of
all; texts without a word (null, empty, blank) are alike. Of a group the document with the least doc_id
stays (ids before none), of several the one with the least hash of its text; rows of equal doc_id and
text are one document. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import CELL, TOLD, distinct_pairs, following, least_shared, meet, nearest, sketches, unlike, unlike_cells, words_of
from .common import fresh, partitions, text_of, written
from .components import components
from .simhash import Forest, ranges, trie_links, whole_groups
from .textarrays import Words, flat, mixed, packed, slices, unpacked, utf8, window_hashes

#: Words of a shingle; least shared shingles of copies in 100 different ones.
SHINGLE, SHARE = 5, 80
#: Least hashes of a text, bands, and least hashes by which a band's rows are sorted (the first two name a group).
HASHES, BANDS, DEPTH = 20, 10, 5
#: Bits in which linked fingerprints may differ, step by step; forests of links that a group gives.
STEPS, FORESTS = (2, 4, 6, 8, 10, 12, 14, 17, 20), 3
#: Texts of a group that are walked together, rows that a task holds, pairs of texts compared at a time.
GROUP_ROWS, GATHERED, COMPARED = 4096, 1 << 16, 2000


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' shingles, and where each text's begin: one at least for each text."""
    words = Words(data, offsets)
    h = words.hashes(lower=True)
    n = np.diff(words.of)
    out = np.zeros(int(np.maximum(n - size + 1, 1).sum()), np.uint64)
    edge = np.concatenate([[0], np.cumsum(np.maximum(n - size + 1, 1))])
    long = np.repeat(n >= size, np.maximum(n - size + 1, 1))
    at = words.windows(size)
    out[long] = window_hashes(h, at, size)
    for i in np.flatnonzero(n < size).tolist():  # of a few words each
        own = h[words.of[i] : words.of[i + 1]]
        out[edge[i]] = window_hashes(own, np.zeros(1, int), len(own))[0] if len(own) else 0
    return out, edge


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint of each text, and its HASHES least hashes (32 bits of each)."""
    data, offsets = utf8(column)
    fps, least = [np.zeros(0, np.uint64)], [np.zeros((0, HASHES), np.uint32)]
    turn = mixed(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        h, edge = shingles(data[part[0] : part[-1]], part - part[0])
        n = np.diff(edge)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Sums of bytes in runs of at most 255, then of runs.
        runs = np.concatenate([np.arange(a, z, 255) for a, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)])
        counts = np.add.reduceat(np.add.reduceat(bits, runs, axis=0, dtype=np.uint8).astype(np.int64), np.searchsorted(runs, edge[:-1]), axis=0)
        fps.append(np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").reshape(-1, 8).view(np.uint64)[:, 0])
        mins = [np.minimum.reduceat((h * (turn[2 * k] | np.uint64(1)) + turn[2 * k + 1]) >> np.uint64(32), edge[:-1]) for k in range(HASHES)]
        least.append(np.stack(mins, 1).astype(np.uint32))
    return np.concatenate(fps), np.concatenate(least)


def _marked(docs: DataFrame) -> DataFrame:
    """mark, fp, least (bytes) of every row: the text's mark tells different texts apart."""

    def batches(rows):
        for b in rows:
            fp, least = features(b.column(1))
            raw = least.astype("<u4").tobytes()
            wide = 4 * HASHES
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64)), pa.array([raw[i : i + wide] for i in range(0, len(raw), wide)], pa.binary())], ["mark", "fp", "least"])

    return docs.select(_mark().alias("mark"), text_of().alias("text")).mapInArrow(batches, "mark string, fp long, least binary")


def _mark():
    return F.md5(text_of().cast("binary"))


def _dealt(texts: DataFrame) -> tuple[DataFrame, list[str]]:
    """(node, fp, least) of distinct texts -> a row for each band, with its least hashes; and these columns' names in order."""
    names = ["band", *(f"k{i}" for i in range(DEPTH)), "fp", "node"]

    def dealt(batches):
        for b in batches:
            node, fp = b.column(0).to_numpy(), b.column(1).to_numpy()
            least = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u4").reshape(-1, HASHES).astype(np.int64)
            for band in range(BANDS):
                keys = [least[:, (2 * band + i) % HASHES] for i in range(DEPTH)]
                yield pa.record_batch([pa.array(np.full(len(node), band, np.int32)), *(pa.array(k) for k in keys), pa.array(fp), pa.array(node)], names)

    shape = "band int, " + ", ".join(f"k{i} long" for i in range(DEPTH)) + ", fp long, node long"
    return texts.select("node", "fp", "least").mapInArrow(dealt, shape), names


def candidates(texts: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(node, fp, least) of distinct texts -> (u, v): links between near fingerprints that meet in a band.

    With u = v, texts that may be near others without a link: those of a run beyond group_rows, or of one that
    another task has rows of.
    """
    rows, names = _dealt(texts)
    order = names[:-1]
    rows = rows.repartitionByRange(partitions(texts), *order).sortWithinPartitions(*order)

    def joined(batches):
        for columns in whole_groups(batches, names, 3, GATHERED, pieces=True):
            i, j = group_links(columns[: DEPTH + 1], columns[-2].astype(np.int64).view(np.uint64), group_rows)
            start, end = ranges(*columns[:3])
            open_ = end - start > group_rows
            open_[[0, -1]] = True
            own = np.flatnonzero(np.repeat(open_, end - start))
            i, j = np.concatenate([i, own]), np.concatenate([j, own])
            yield pa.record_batch([pa.array(columns[-1][i].astype(np.int64)), pa.array(columns[-1][j].astype(np.int64))], ["u", "v"])

    return rows.mapInArrow(joined, "u long, v long")


def sketched(frames: DataFrame) -> DataFrame:
    """(node, n, sketch) of texts (node, frame): how many different shingles they have, and their parities."""

    def run(batches):
        for b in batches:
            for first, last, texts in unpacked(b.column(1)):
                h, edge = shingles(*flat(texts))
                of = np.repeat(np.arange(len(texts)), np.diff(edge))
                order = np.lexsort((h, of))
                h = h[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])
                h, of = h[new], of[new]
                sketch = sketches(h, of, len(texts))
                yield pa.record_batch([b.column(0).slice(first, last - first), pa.array(np.bincount(of, minlength=len(texts))), pa.array([x.tobytes() for x in sketch], pa.binary())], ["node", "n", "sketch"])

    return frames.select("node", "frame").mapInArrow(run, "node long, n long, sketch binary")


def likely(pairs: DataFrame, told: DataFrame, share: int) -> DataFrame:
    """The (u, v) of pairs that may be alike by their sketches; told: rows of sketched()."""
    side = lambda c: told.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    d = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "n_u", "n_v", "s_u", "s_v")

    def run(batches):
        for b in batches:
            m, n = (b.column(k).to_numpy() for k in (2, 3))
            gap = unlike(*(words_of(b.column(k).to_pylist()) for k in (4, 5)))
            yield b.select([0, 1]).filter(pa.array(gap <= m + n - 2 * least_shared(m, n, share)))

    return d.mapInArrow(run, "u long, v long")


def _meeting(texts: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """A row for each band of the texts that told has: its run's hashes, and what is told of it."""
    rows = _dealt(texts.join(told.select("node"), "node"))[0].select("band", "k0", "k1", "fp", "node")
    named = told.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows.join(named, "node")


def remaining(rows: DataFrame, share: int, parts: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(u, v): all pairs of a run, rows of _meeting(), that are near, of unlike components and may be alike by their sketches."""
    run, errors = ["band", "k0", "k1"], STEPS[-1]
    names = [*run, *CELL, "fp", "node", "n", "sketch", *TOLD]
    rows = unlike_cells(rows, run, group_rows).select(*names)
    rows = rows.repartition(parts, *names[:6]).sortWithinPartitions(*names[:6])

    def paired(batches):
        for columns in whole_groups(batches, names, 6, GATHERED):
            held = dict(zip(names, columns, strict=True))
            start, end = ranges(*columns[:6])
            fp, node, n, sketch = held["fp"].astype(np.int64).view(np.uint64), held["node"].astype(np.int64), held["n"], words_of(held["sketch"])
            for i, j in following(np.repeat(end, end - start)):
                ok = np.bitwise_count(fp[i] ^ fp[j]) <= errors
                i, j = i[ok], j[ok]
                ok = meet(held, i, j)
                i, j = i[ok], j[ok]
                ok = unlike(sketch[i], sketch[j]) <= n[i] + n[j] - 2 * least_shared(n[i], n[j], share)
                u, v = distinct_pairs(node[i[ok]], node[j[ok]])
                if len(u):
                    yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.mapInArrow(paired, "u long, v long").distinct()


def group_links(keys: list[np.ndarray], fp: np.ndarray, group_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of a group (equal first three keys; the others part one beyond group_rows) whose fingerprints are near."""
    n = len(fp)
    start, end = ranges(*keys[:3])
    run = np.repeat(np.arange(len(start)), end - start)
    group = run.copy()
    for depth in range(3, len(keys) + 1):
        large = np.bincount(group)[group] > group_rows
        if not large.any():
            break
        new = np.zeros(n, bool)
        new[1:] = group[1:] != group[:-1]
        if depth < len(keys):
            new[1:] |= large[1:] & (keys[depth][1:] != keys[depth][:-1])
        else:  # alike in all: in order of fingerprint, so many at a time
            first = np.flatnonzero(np.concatenate([[True], new[1:]]))
            new |= large & ((np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))) % group_rows == 0)
        group = np.cumsum(new)
    order = np.lexsort((fp, group))
    fp, group, head = fp[order], group[order], start[run[order]]
    a, z = ranges(group)
    parted = head[a] != a  # parts of a run after its first one
    at = np.empty(n, int)
    at[order] = np.arange(n)
    lead = at[head[a[parted]]]
    many = z - a > 1
    al, ah, bl, bh = (np.concatenate(x) for x in ((a[many], lead), (z[many], lead + 1), (a[many], a[parted]), (z[many], z[parted])))
    found = (np.zeros(0, int), np.zeros(0, int))
    same = np.flatnonzero((fp[1:] == fp[:-1]) & (group[1:] == group[:-1]))
    for turn in range(FORESTS):
        if turn == 1:  # groups of two have no more links
            more = (ah - al) * (bh - bl) > 4
            al, ah, bl, bh = (x[more] for x in (al, ah, bl, bh))
        if not len(al):
            break
        forest = Forest(n, found)
        forest.join(same, same + 1)
        for errors in STEPS:
            trie_links(fp, al, ah, bl, bh, errors, 63, 0, forest)
        found = tuple(np.concatenate(x) for x in zip(found, forest.found(), strict=True))
    return order[found[0]], order[found[1]]


def overlaps(left: list[bytes], right: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shared shingles and all different ones of each pair of texts."""
    n = len(left)
    h, edge = shingles(*flat([*left, *right]), size)
    side = np.repeat(np.arange(2 * n), np.diff(edge))
    # Each text's different shingles, then each pair's: what a pair has twice is shared.
    order = np.lexsort((h, side))
    h, side = h[order], side[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (side[1:] != side[:-1])])
    h, pair = h[first], side[first] % n
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    twice = np.concatenate([[False], (h[1:] == h[:-1]) & (pair[1:] == pair[:-1])])
    both = np.bincount(pair[twice], minlength=n)
    return both, np.bincount(pair, minlength=n) - both


def likeness(left: list[bytes], right: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Shared shingles over all different ones of each pair of texts."""
    both, all_ = overlaps(left, right, size)
    return both / np.maximum(all_, 1)


def compared(pairs: DataFrame, frames: DataFrame, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int = SHINGLE) -> DataFrame:
    """The (u, v) of pairs for which alike(shared, all) holds; frames: (node, frame) of nodes' texts."""
    d = pairs.join(frames.select(F.col("node").alias("u"), F.col("frame").alias("left")), "u").join(frames.select(F.col("node").alias("v"), F.col("frame").alias("right")), "v")

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, COMPARED):
                part = b.slice(k, COMPARED)
                keep = []
                texts_ = [[x for _, _, t in unpacked(part.column(c)) for x in t] for c in (2, 3)]
                sizes, i = np.cumsum([len(x) + len(y) for x, y in zip(*texts_, strict=True)]), 0
                while i < part.num_rows:
                    done = sizes[i - 1] if i else 0
                    j = max(i + 1, int(np.searchsorted(sizes, done + (1 << 22), "right")))
                    keep.append(alike(*overlaps(texts_[0][i:j], texts_[1][i:j], size)))
                    i = j
                yield part.select([0, 1]).filter(pa.array(np.concatenate(keep)))

    return d.select("u", "v", "left", "right").mapInArrow(run, "u long, v long")


def text_frames(nodes: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, frame) of the texts of nodes; texts: (node, mark)."""
    wanted = texts.select("node", "mark").join(nodes, "node").withColumnRenamed("mark", "_wanted")
    rows = docs.select(_mark().alias("_text_mark"), text_of().alias("text"))
    # One text for each mark; rows of equal mark have equal texts.
    found = packed(rows.join(wanted, F.col("_text_mark") == F.col("_wanted")).select("node", "text"), "text", "frame")
    return written(found.groupBy("node").agg(F.min("frame").alias("frame")), docs)


def groups(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(mark, component) of each distinct text: texts of one component are near-duplicates."""
    each = _marked(docs).groupBy("mark").agg(F.min("fp").alias("fp"), F.min("least").alias("least"))
    texts = written(each.withColumn("node", F.monotonically_increasing_id()), docs)
    parts = partitions(docs)
    pairs = candidates(texts, group_rows).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = written(pairs, docs)
    frames = text_frames(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).distinct(), texts, docs)
    told = written(sketched(frames), docs)
    alike = lambda both, all_: 100 * both >= SHARE * np.maximum(all_, 1)
    joined = lambda found, more: components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more), docs)
    tried = written(likely(pairs.where("u != v"), told, SHARE), docs)
    found = components(compared(tried, frames, alike), docs)
    # What the first links have left apart: each text with its likeliest, then all that may be alike.
    rows = _meeting(texts, found, told).select(F.xxhash64("band", "k0", "k1").alias("key"), "n", "node", "component", "sketch")
    new = written(nearest(written(rows, docs), parts, SHARE).join(tried, ["u", "v"], "left_anti"), docs)
    if not new.isEmpty():
        found, tried = joined(found, compared(new, frames, alike)), tried.unionAll(new)
    rest = written(remaining(_meeting(texts, found, told), SHARE, parts, group_rows).join(tried, ["u", "v"], "left_anti"), docs)
    if not rest.isEmpty():
        found = joined(found, compared(rest, frames, alike))
    return texts.join(found, "node", "left").select("mark", F.coalesce("component", F.col("node")).alias("component"))


def keep_one(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One document of each group of near-duplicates, with its own columns; which one, says the module."""
    mark, component, chosen = fresh(docs.columns, "_mark", "_component", "_chosen")
    named = written(groups(docs.select("doc_id", "text"), group_rows), docs)
    ids = docs.select(F.col("doc_id").cast("long").alias("id"), _mark().alias("_own")).join(named, F.col("_own") == F.col("mark"))
    first = ids.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("first"))
    first = first.select(F.col("first.id").alias(component), F.col("first.mark").alias(chosen))
    marked = docs.withColumn(mark, _mark())
    # The chosen text's mark names one component, so an id that groups share does no harm.
    same = (F.col(mark) == F.col(chosen)) & docs["doc_id"].cast("long").eqNullSafe(F.col(component))
    return marked.join(first, same, "left_semi").dropDuplicates(["doc_id", mark]).select(*docs.columns)
