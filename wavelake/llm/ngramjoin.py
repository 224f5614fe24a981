"""Documents whose sets of word shingles have a Jaccard similarity of a bound or more, joined by their rarest shingles.

All shingles have one order, rare ones first. Sets that are alike enough share one among the first
n - ceil(bound * n) + 1 of each (its prefix), so only prefixes are joined:

1. Documents are read in chunks. Each sends the cells of a partitioned count table that its shingles
   fall in; the merged blocks answer each chunk with the class (a power of two) of each cell's count. No
   table of counts is held or sent as a whole, and its width follows the input without a bound. A count is
   never too low, so a shingle that counts once occurs in no other document and is left out of the join.
2. Each document orders its shingles by class and hash and yields its prefix: shingle, place, and how many
   of the shingles after it fall in each of eight parts of the hash space. Equal sets are one node.
3. Nodes that share a prefix shingle are joined on it. A pair has to pass the length filter (sizes), the
   positional filter (what can be shared from these places on) and the suffix filters (the parts'
   differences, which the sets cannot make good; then those of parities of counts by hash, of which no
   more can differ than shingles do). What passes is compared once, on all its shingles.

A group of m near copies has m * m pairs but needs m - 1 links. So each node is first compared with the
nearest by parities of those before it by size, in each of the HOMES largest groups it is in, and these
links' components are found; after that pairs within a component are left out, and all others that pass
the filters are compared: nothing is lost. A shingle's group beyond GROUP_ROWS is dealt out as pairs of
blocks, rows of its largest component only against other rows.

Defined cases: A-Z count as a-z; a text with fewer words than a shingle is one shingle of all; without a word
(null, empty, blank) it has no shingle and is linked with nothing; equal sets are linked; rows that
share a doc_id are texts of their own; null ids name no component (null where a component has no id); no rows
give no rows. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import CELL, TOLD, distinct_pairs, following, least_shared, meet, nearest, sketches, unlike, unlike_cells, words_of
from .common import compact, partitions, table, text_of, written
from .components import components
from .copies import compared, shingles
from .passages import LEAST_BITS, Layout, _chunks, _gaps, _met, _numbers, _parted, _payloads
from .simhash import ranges, whole_groups
from .textarrays import slices, utf8

#: Words of a shingle; least shared shingles in 100 different ones.
SHINGLE, SHARE = 4, 85
#: Groups in which a node first meets others; rows of a group that are joined in one place.
HOMES, GROUP_ROWS = 2, 4096
#: Rows a task holds; bytes of text of a chunk at most.
GATHERED, CHUNK = 1 << 16, 48 << 20
#: Parts of the hash space whose counts the suffix filter compares.
PARTS = 8


def prefix(n: np.ndarray, share: int = SHARE) -> np.ndarray:
    """How many of a set's n rarest shingles a partner has to share one of."""
    return n - (share * n + 99) // 100 + 1


def sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, in order, and where each text's begin."""
    data, offsets = utf8(column)
    out, counts = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        h, edge = shingles(data[part[0] : part[-1]], part - part[0], size)
        n = np.diff(edge)
        of = np.repeat(np.arange(last - first), n)
        order = np.lexsort((h, of))
        h = h[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])]) & ((h != 0) | (n[of] > 1))
        out.append(h[new])
        counts.append(np.bincount(of[new], minlength=last - first))
    return np.concatenate(out), np.cumsum(np.concatenate(counts))


def _runs(cells: np.ndarray) -> np.ndarray:
    """Where runs of equal ones start in sorted cells, and their end."""
    return np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]])) if len(cells) else np.zeros(1, int)


def _asked(docs: DataFrame, size: int, plan: Layout) -> DataFrame:
    """(chunk, block, n, cells, counts): how many of a chunk's documents have a shingle in each cell."""
    low, mask, shift = np.uint64(plan.low), np.uint64((1 << plan.low) - 1), np.uint64(64 - plan.bits)

    def asked(batches):
        for chunk, held in _chunks(batches, 0, plan.chunk):
            cells = np.sort(np.concatenate([sets(b.column(0), size)[0] for b in held]) >> shift)
            at = _runs(cells)
            counts = np.minimum(np.diff(at), 255).astype(np.uint8)
            cells = cells[at[:-1]]
            edges = _runs(cells >> low)
            out = []
            for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out.append((chunk, int(cells[a] >> low), z - a, _gaps(cells[a:z] & mask), pa.compress(counts[a:z].tobytes(), codec="zstd", asbytes=True)))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["chunk", "block", "n", "cells", "counts"])

    return _parted(docs.select("text")).mapInArrow(asked, "chunk long, block long, n int, cells binary, counts binary")


def rarity(docs: DataFrame, size: int, plan: Layout, parts: int) -> DataFrame:
    """(chunk, block, data): for each cell that a chunk has sent, in order, the class of its count: 0 for one, k for up to 2 ** k."""

    def merged(batches):
        now, held = None, []

        def done():
            total = np.zeros(1 << plan.low, np.uint16)
            asked = [(chunk, n, np.cumsum(_numbers(cells, n), dtype=np.uint32), np.frombuffer(pa.decompress(counts, n, codec="zstd", asbytes=True), np.uint8)) for chunk, n, cells, counts in held]
            for _, _, cells, counts in asked:
                total[cells] = np.minimum(total[cells].astype(np.uint32) + counts, 1 << 15)
            rank = np.zeros(1 << 16, np.uint8)
            rank[1:] = np.ceil(np.log2(np.arange(1, 1 << 16))).astype(np.uint8)
            rows = [(chunk, now, pa.compress(rank[total[cells]].tobytes(), codec="zstd", asbytes=True)) for chunk, _, cells, _ in asked]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "block", "data"])

        for b in batches:
            for chunk, block, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != now:
                    if held:
                        yield done()
                    now, held = block, []
                held.append((chunk, *rest))
        if held:
            yield done()

    rows = _asked(docs, size, plan).repartition(parts, "block").sortWithinPartitions("block")
    return rows.mapInArrow(merged, "chunk long, block long, data binary")


_PREFIXED = "doc_id long, hi long, lo long, n long, shingles binary, places binary, tails binary, sketch binary, frame binary"


def _tails(h: np.ndarray, edge: np.ndarray, of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of `at`, how many of its set's shingles after it lie in each part, up to 255, a byte each."""
    out = np.zeros(len(at), np.uint64)
    part = h & np.uint64(PARTS - 1)
    for k in range(PARTS):
        up = np.concatenate([[0], np.cumsum(part == np.uint64(k), dtype=np.int64)])
        out |= np.minimum(up[edge[of[at] + 1]] - up[at + 1], 255).astype(np.uint64) << np.uint64(8 * k)
    return out


def prefixed(docs: DataFrame, size: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """A row for each of docs (doc_id long, text): its set's mark (hi, lo) and size and, if others may share its prefix, that and the text."""
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    plan, parts = Layout(volume, LEAST_BITS), partitions(docs)
    plan.chunk = min(plan.chunk, CHUNK)
    shift = np.uint64(64 - plan.bits)
    told = written(rarity(docs, size, plan, parts), docs).select("chunk", F.lit(0).alias("kind"), F.lit(0).alias("row"), "block", "data")
    payload = _payloads(docs, plan).select("chunk", F.lit(2).alias("kind"), F.lit(0).alias("row"), F.lit(0).cast("long").alias("block"), F.col("payload").alias("data"))

    def rows_of(b, h, edge, cls):
        n, ids = np.diff(edge), b.column(0)
        of = np.repeat(np.arange(len(n)), n)
        marks = [xxhash.xxh3_128_digest(h[i:j].tobytes()) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        marks = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
        order = np.argsort(of.astype(np.int64) * 16 + np.minimum(cls, 15), kind="stable")  # shingles are in order of hash
        h, cls = h[order], cls[order]
        place = np.arange(len(h)) - edge[of]
        at = np.flatnonzero((place < prefix(n, share)[of]) & (cls > 0))
        mine, tails, place = np.searchsorted(of[at], np.arange(len(n) + 1)), _tails(h, edge, of, at), place[at].astype("<u4")
        token, sketch = h[at], sketches(h, of, len(n))
        data, offsets = utf8(b.column(1))
        raw, press = memoryview(data), zstandard.ZstdCompressor(level=1)
        out = [[], [], [], [], []]
        for k, (i, j) in enumerate(zip(mine[:-1].tolist(), mine[1:].tolist(), strict=True)):
            some = (token[i:j].tobytes(), place[i:j].tobytes(), tails[i:j].tobytes(), sketch[k].tobytes(), press.compress(raw[offsets[k] : offsets[k + 1]])) if j > i else (None,) * 5
            for x, v in zip(out, some, strict=True):
                x.append(v)
        return pa.record_batch([ids, pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array(n), *(pa.array(x, pa.binary()) for x in out)], [c.split()[0] for c in _PREFIXED.split(", ")])

    def cut(batches):
        now, told_ = None, []
        for rows in batches:
            for k, (chunk, kind) in enumerate(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)):
                data = rows.column(4)[k].as_buffer()  # no copy: a batch holds many chunks' texts
                if chunk != now:
                    now, told_ = chunk, []
                if kind == 0:
                    told_.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8))
                    continue
                with pa.ipc.open_stream(data) as stream:
                    held = list(stream)
                found = [sets(b.column(1), size) for b in held]
                cells = np.concatenate([h for h, _ in found]) >> shift
                order = np.argsort(cells, kind="stable")
                cls = np.empty(len(cells), np.uint8)
                if len(cells):
                    cls[order] = np.repeat(np.concatenate(told_), np.diff(_runs(cells[order])))
                del cells, order
                done = 0
                for b, (h, edge) in zip(held, found, strict=True):
                    yield rows_of(b, h, edge, cls[done : done + len(h)])
                    done += len(h)

    return _met(parts, told, payload).mapInArrow(cut, _PREFIXED)


def _exploded(nodes: DataFrame) -> DataFrame:
    """(shingle, n, node, place, tail) of each shingle of the nodes' prefixes."""

    def run(batches):
        for b in batches:
            node, n = (b.column(k).to_numpy() for k in (0, 1))
            token, place, tail = (np.frombuffer(b"".join(b.column(k).to_pylist()), t) for k, t in ((2, "<i8"), (3, "<i4"), (4, "<i8")))
            each = np.array([len(x.as_py()) // 8 for x in b.column(2)], int)
            yield pa.record_batch([pa.array(token), pa.array(np.repeat(n, each)), pa.array(np.repeat(node, each)), pa.array(place.astype(np.int32)), pa.array(tail)], ["shingle", "n", "node", "place", "tail"])

    return nodes.select("node", "n", "shingles", "places", "tails").mapInArrow(run, "shingle long, n long, node long, place int, tail long")


def neighbours(grouped: DataFrame, nodes: DataFrame, parts: int, share: int = SHARE) -> DataFrame:
    """(u, v): each node with the nearest by sketch of those before it by size, in each of the HOMES largest groups that it is in."""
    w = Window.partitionBy("node").orderBy(F.desc("m"), "shingle")
    homes = grouped.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= HOMES).select("shingle", "n", "node")
    homes = homes.join(nodes.select("node", "sketch"), "node").select(F.col("shingle").alias("key"), "n", "node", F.col("node").alias("component"), "sketch")
    return nearest(written(homes, grouped), parts, share)


def candidates(grouped: DataFrame, found: DataFrame, nodes: DataFrame, parts: int, share: int = SHARE, group_rows: int | None = None) -> DataFrame:
    """(u, v) of nodes of unlike components that share a prefix shingle and pass the length, positional and suffix filters.

    grouped: rows of _exploded(); found: (node, component) of nodes that have been linked so far.
    """
    named = nodes.select("node", "sketch").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = grouped.join(named, "node")
    names = ["shingle", *CELL, "n", "node", "place", "tail", "sketch", *TOLD]
    rows = unlike_cells(rows, ["shingle"], group_rows or GROUP_ROWS).select(*names)
    rows = rows.repartition(parts, *names[:4]).sortWithinPartitions(*names[:5])

    def paired(batches):
        for columns in whole_groups(batches, names, 4, GATHERED):
            held = dict(zip(names, columns, strict=True))
            start, end = ranges(*columns[:4])
            group = np.repeat(np.arange(len(start)), end - start)
            size, node, place, tail, sketch = held["n"].astype(np.int64), held["node"], held["place"], held["tail"], words_of(held["sketch"])
            # Sizes ascend in a group: each row's partners by the length filter are those that follow, up to a size.
            last = np.searchsorted((group << 40) + size, (group << 40) + 100 * size // share, "right")
            for i, j in following(last):
                ok = meet(held, i, j)
                i, j = i[ok], j[ok]
                need = least_shared(size[i], size[j], share)
                left, right = size[i] - place[i] - 1, size[j] - place[j] - 1
                ok = 1 + np.minimum(left, right) >= need
                i, j, need, left, right = (x[ok] for x in (i, j, need, left, right))
                after = [np.ascontiguousarray(tail[x]).view(np.uint8).reshape(-1, PARTS).astype(np.int16) for x in (i, j)]
                ok = np.abs(after[0] - after[1]).sum(1) <= left + right - 2 * (need - 1)
                i, j, need = i[ok], j[ok], need[ok]
                ok = unlike(sketch[i], sketch[j]) <= size[i] + size[j] - 2 * need
                u, v = distinct_pairs(node[i[ok]], node[j[ok]])
                if len(u):
                    yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return rows.mapInArrow(paired, "u long, v long").distinct()


def linked(nodes: DataFrame, source: DataFrame, size: int = SHINGLE, share: int = SHARE, group_rows: int | None = None) -> DataFrame:
    """(node, component) of nodes (rows of prefixed() with node) that are linked with one of lesser number."""
    parts = partitions(source)
    rows = _exploded(nodes)
    shared = rows.groupBy("shingle").agg(F.count("*").alias("m")).where("m > 1").withColumnRenamed("shingle", "_s")
    grouped = written(rows.join(shared, F.col("shingle") == F.col("_s")).drop("_s"), source)
    frames = nodes.select("node", "frame")
    alike = lambda both, all_: 100 * both >= share * all_
    first = written(neighbours(grouped, nodes, parts, share), source)
    links = written(compared(first, frames, alike, size), source)
    found = components(links, source)
    rest = written(candidates(grouped, found, nodes, parts, share, group_rows).join(first, ["u", "v"], "left_anti"), source)
    more = compared(rest, frames, alike, size)
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionAll(more), source)


def jaccard_join(docs: DataFrame, size: int = SHINGLE, share: int = SHARE, group_rows: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs; see the module."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = written(prefixed(docs, size, share), docs)
    nodes = rows.where("shingles is not null").drop("doc_id").dropDuplicates(["hi", "lo"])
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), docs)
    found = linked(nodes, docs, size, share, group_rows)
    members = rows.select("doc_id", "hi", "lo", F.col("n").alias("n_shingles"))
    own = members.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"))
    component = nodes.select("hi", "lo", "node").join(found, "node").select("hi", "lo", "component")
    # A linked set's class is named by a node, whose number says nothing of ids; the class's least id names it in turn.
    component = component.unionAll(nodes.join(found.select(F.col("component").alias("node")).distinct(), "node").select("hi", "lo", F.col("node").alias("component")))
    own = written(own.join(component, ["hi", "lo"], "left"), docs)
    least = own.where("component is not null").groupBy("component").agg(F.min("least").alias("class"))
    # Sets without links, and rows without a set, take no part in the joins: there are many of them under one key.
    lone = own.where("component is null").select("hi", "lo", F.col("least").alias("class"))
    own = own.join(least, "component").select("hi", "lo", "class").unionAll(lone)
    d = members.where("n_shingles > 0").join(own, ["hi", "lo"]).select("doc_id", "n_shingles", F.col("class").alias("component_id"))
    return d.unionAll(members.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op11_ngramjoin(spark, sf_dir):
    """op11's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compact(jaccard_join(docs), docs)
