"""SimHash near-duplicates joined by walking a binary trie against itself.

A fingerprint sets each of its 64 bits if over half of the hashes of a text's word shingles set it.
Of errors + a blocks of their bits, two fingerprints that differ in at most `errors` bits agree in at
least a; each distinct fingerprint is dealt out once for each choice of a blocks, by their values. a is
one for a few hundred million fingerprints and grows with their number, so that groups stay small.
Within a dealt group a binary trie over the other bits is walked as pairs of nodes: both nodes go
one bit deeper together, a pair whose branches differ counts an error, and a pair over the error
budget is pruned with all below it. Pairs of small nodes are compared outright. A pair of nodes
whose leaves are one component already is pruned too, and a group gives only links that join
something new, so that a cluster of m close fingerprints yields m - 1 links and not m * m. Groups
lie in sorted runs, of which a task holds a few at a time.

A group beyond `group_rows` is split: its next c bits name subtrees, and each pair of subtrees
within the error budget is a group of its own, dealt out on its own. One that is still beyond what a
task gathers is split in the same way by its next bits, as often as that takes.

Defined cases: null and empty texts have fingerprint 0 and link like any other; fewer words than a
shingle's make one shingle of all; equal texts have equal fingerprints; rows that share a doc_id
are links of one node; null ids take no part in the naming of a component and get their component's
least id (null if it has none).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compact, partitions, table, written
from .components import components

#: Words of a shingle, seed of its hash, bits in which linked fingerprints may differ.
SHINGLE, HASH_SEED, ERRORS = 3, 42, 3
#: Distinct fingerprints of a block value that one task joins; larger groups are split into pairs of subtrees.
GROUP_ROWS = 4096
#: Node pairs compared outright, and node pairs expanded at a time.
LEAF, CHUNK = 64, 1 << 18
#: Rows of groups that a task walks together.
GATHERED = 1 << 17


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = HASH_SEED) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    if n == 1:
        shingles = iter((b" ".join(words),))
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=seed), shingles), np.uint64, n)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, np.arange(0, n, 255), axis=0, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def batches(rows):
        for b in rows:
            fps = np.array([fingerprint(x.as_py(), size) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches, "doc_id long, fp long")


class Forest:
    """Which leaves are linked so far, and the links that joined something new, in order."""

    def __init__(self, n: int, without: tuple[np.ndarray, np.ndarray] | None = None):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.without = None if without is None else np.sort(np.minimum(*without) * n + np.maximum(*without))

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate([np.zeros(0, int), *x]) for x in (zip(*self.links, strict=True) if self.links else ((), ())))

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link leaves, but for links that the forest is without; of the links between two components one is kept."""
        if self.without is not None and len(i) and len(self.without):
            code = np.minimum(i, j) * len(self.root) + np.maximum(i, j)
            new = self.without[np.minimum(np.searchsorted(self.without, code), len(self.without) - 1)] != code
            i, j = i[new], j[new]
        while len(i):
            a, b = self.root[i], self.root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if not len(i):
                return
            # Each component hooks on to one of lesser root, so no circle arises.
            high, at = np.unique(np.maximum(a, b), return_index=True)
            self.root[high] = np.minimum(a, b)[at]
            self.links.append((i[at], j[at]))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def trie_links(keys: np.ndarray, al, ah, bl, bh, errors: int, bit: int, spent: int | np.ndarray = 0, forest: Forest | None = None) -> Forest:
    """The forest (of indices into keys) after linking leaves that differ in at most errors bits.

    al:ah and bl:bh are ranges of keys, the node pairs to start from; in each range keys ascend and the
    bits above `bit` differ in `spent` places from those of the other. Every leaf pair is compared on all
    64 bits at last.
    """
    forest = forest or Forest(len(keys))
    start = np.broadcast_to(np.asarray(spent), len(al))
    todo = [(bit, np.asarray(al), np.asarray(ah), np.asarray(bl), np.asarray(bh), start)]
    ones: dict[int, np.ndarray] = {}
    while todo:
        bit, al, ah, bl, bh, err = todo.pop()
        if len(al) > CHUNK:
            half = len(al) // 2
            todo += [(bit, *(x[half:] for x in (al, ah, bl, bh, err))), (bit, *(x[:half] for x in (al, ah, bl, bh, err)))]
            continue
        change = np.concatenate([[0], np.cumsum(forest.root[1:] != forest.root[:-1])]) if len(keys) else np.zeros(1, int)
        one = (change[ah - 1] == change[al]) & (change[bh - 1] == change[bl]) & (forest.root[al] == forest.root[bl])
        keep = ~one
        al, ah, bl, bh, err = (x[keep] for x in (al, ah, bl, bh, err))
        count = (ah - al) * (bh - bl)
        small = (count <= LEAF) | (bit < 0)
        if small.any():
            n, w = count[small], (bh - bl)[small]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            i, j = np.repeat(al[small], n) + at // np.repeat(w, n), np.repeat(bl[small], n) + at % np.repeat(w, n)
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= errors) & (i != j)
            forest.join(i[near], j[near])
        al, ah, bl, bh, err = (x[~small] for x in (al, ah, bl, bh, err))
        if not len(al):
            continue
        # A node's keys with the bit unset come first: their number tells where its two branches part.
        if bit not in ones:
            ones.clear()
            ones[bit] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
        up = ones[bit]
        am, bm = ah - (up[ah] - up[al]), bh - (up[bh] - up[bl])
        same = (al == bl) & (ah == bh)
        parts = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(x[~same] for x in (am, ah, bl, bm, err + 1))]
        al, ah, bl, bh, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (al < ah) & (bl < bh) & (err <= errors)
        todo.append((bit - 1, *(x[keep] for x in (al, ah, bl, bh, err))))
    return forest


def ranges(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, int), np.zeros(0, int)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    start = np.flatnonzero(new)
    return start, np.append(start[1:], len(keys[0]))


def whole_groups(batches, names: list[str], by: int, rows: int, pieces: bool = False) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, in pieces of about `rows` rows that end where a group does (the first `by` columns are its key).

    A group beyond `rows` rows is whole too; with pieces, for those who see to the rest themselves, it is handed out in pieces of so many rows.
    """
    held: list[list[np.ndarray]] = [[] for _ in names]
    n = 0
    for b in batches:
        for k, name in enumerate(names):
            held[k].append(b.column(name).to_numpy(zero_copy_only=False))
        n += b.num_rows
        if n >= rows:
            columns = [np.concatenate(h) for h in held]
            start, _ = ranges(*columns[:by])
            cut = int(start[-1]) or (n if pieces else 0)
            if cut:
                yield [c[:cut] for c in columns]
            held, n = [[c[cut:]] for c in columns], n - cut
    if n:
        yield [np.concatenate(h) for h in held]


def blocks_of(n: int, errors: int, group_rows: int) -> tuple[int, int]:
    """(blocks, how many of them must agree): with more fingerprints, longer parts of them name a group.

    Of errors + a blocks at least a are free of errors. Values of a blocks are as many as keep groups
    of evenly spread fingerprints below group_rows.
    """
    for agree in range(1, 5):
        if n <= group_rows << ((64 // (errors + agree)) * agree):
            break
    return errors + agree, agree


def _deeper(split: DataFrame, nodes: DataFrame, errors: int, top: int, rows: int, step: int = 4) -> DataFrame:
    """Pairs of subtrees (band, value, p, q, c, key, node) with none beyond `rows` rows: larger ones are split by their next bits, over and over.

    Errors that a pair's paths have spent are taken off its budget. A pair without rows on both sides has
    no links and is left out, so that keys that share their next bits are not copied at each step. Keys
    are distinct: at their last bit a pair is two rows at most.
    """
    by, out = ["band", "value", "c", "p", "q"], []
    names = ["band", "value", "p", "q", "c", "key", "node"]
    while True:
        split = written(split, nodes)
        at = F.expr(f"shiftrightunsigned(shiftleft(key, {top}), 64 - c)")
        counts = split.groupBy(*by).agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high"))
        counts = counts.where((F.col("_n") > 1) & ((F.col("p") == F.col("q")) | (F.col("_low") < F.col("_high"))))
        counts = written(counts.withColumn("_s", F.when(F.col("_n") > rows, F.least(F.lit(step), F.lit(64 - top) - F.col("c"))).otherwise(0)), nodes)
        held = split.join(counts, by)
        out.append(held.where("_s = 0").select(*names))
        if counts.where("_s > 0").isEmpty():
            break
        steps = range(1, step + 1)
        # Masks of so many bits, for each width of step and each budget that is left.
        balls = [F.array(*[F.lit(sum(1 << b for b in bits)).cast("long") for e in range(left + 1) for bits in combinations(range(s), e)]) for s in steps for left in range(errors + 1)]
        left = F.lit(errors) - F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
        ball = F.element_at(F.array(*balls), ((F.col("_s") - 1) * (errors + 1) + left + 1).cast("int"))
        own = F.expr(f"shiftrightunsigned(shiftleft(key, {top} + c), 64 - _s)")
        d = held.where("_s > 0").withColumn("_own", own).withColumn("_mask", F.explode(ball)).withColumn("_other", F.col("_own").bitwiseXOR(F.col("_mask")))
        low = (F.when(F.col("p") == F.col("q"), F.least("_own", "_other")).when(at == F.col("p"), F.col("_own")).otherwise(F.col("_other"))).alias("_a")
        d = d.select("*", low, F.col("_own").bitwiseXOR(F.col("_other")).alias("_x"))
        under = lambda node, bits: F.expr(f"shiftleft({node}, _s)").bitwiseOR(bits)
        split = d.select("band", "value", under("p", F.col("_a")).alias("p"), under("q", F.col("_a").bitwiseXOR(F.col("_x"))).alias("q"), (F.col("c") + F.col("_s")).cast("int").alias("c"), "key", "node")
    return reduce(DataFrame.unionAll, out)


def links(nodes: DataFrame, errors: int = ERRORS, group_rows: int = GROUP_ROWS, count: int | None = None) -> DataFrame:
    """(fp, node) of distinct fingerprints -> (u, v) of nodes: enough links to join all that differ in at most errors bits."""
    count = nodes.count() if count is None else count
    blocks, agree = blocks_of(count, errors, group_rows)
    width = 64 // blocks
    chosen = list(combinations(range(blocks), agree))
    # A fingerprint is turned for each choice so that the chosen blocks are its highest bits, in order; the other bits follow.
    orders = [[*c, *(k for k in range(blocks) if k not in c)] for c in chosen]
    left = 64 - width * blocks
    block = lambda k: f"(shiftrightunsigned(fp, {64 - width * (k + 1)}) & {(1 << width) - 1}L)"
    turned = lambda order: " | ".join([*(f"shiftleft({block(k)}, {64 - width * (i + 1)})" for i, k in enumerate(order)), *([f"(fp & {(1 << left) - 1}L)"] if left else [])])
    top = width * agree
    dealt = nodes.select("node", F.posexplode(F.array(*[F.expr(turned(o)) for o in orders])).alias("band", "key")).withColumn("value", F.expr(f"shiftrightunsigned(key, {64 - top})"))
    # Groups are counted on their blocks' values; only values beyond group_rows (so at most rows * choices / group_rows) are kept.
    hot = dealt.groupBy("band", "value").count().where(F.col("count") > group_rows)
    hot = written(hot.select("band", "value", F.least(F.ceil(F.log2(F.col("count") / group_rows)), F.lit(64 - top)).cast("int").alias("c")), nodes)
    largest = hot.agg(F.max("c")).first()[0] or 0
    dealt = dealt.join(hot, ["band", "value"], "left")
    zero = F.lit(0).cast("long")
    normal = dealt.where("c is null").select("band", "value", zero.alias("p"), zero.alias("q"), F.lit(0).alias("c"), "key", "node")
    groups = normal
    if largest:
        # Each subtree of c bits meets those within the error budget: its own and the ones a mask of few bits leads to.
        masks = {c: [sum(1 << b for b in bits) for e in range(errors + 1) for bits in combinations(range(c), e)] for c in range(1, largest + 1)}
        ball = F.element_at(F.create_map(*[x for c, m in masks.items() for x in (F.lit(c), F.array(*[F.lit(v).cast("long") for v in m]))]), F.col("c"))
        split = dealt.where("c is not null").withColumn("_sub", F.expr(f"shiftrightunsigned(shiftleft(key, {top}), 64 - c)")).withColumn("_mask", F.explode(ball))
        other = F.col("_sub").bitwiseXOR(F.col("_mask"))
        split = split.select("band", "value", F.least("_sub", other).alias("p"), F.greatest("_sub", other).alias("q"), "c", "key", "node")
        groups = normal.unionAll(_deeper(split, nodes, errors, top, GATHERED))
    by = ["band", "value", "c", "p", "q"]
    groups = groups.repartition(partitions(nodes), *by).sortWithinPartitions(*by, "key")

    def joined(batches):
        for band, value, c, p, q, key, node in whole_groups(batches, [*by, "key", "node"], 5, GATHERED):
            key = key.astype(np.int64).view(np.uint64)
            a, z = ranges(band, value, c, p, q)
            many = z - a > 1
            own = many & (c[a] == 0)
            starts = [(a[own], z[own], a[own], z[own], np.full(own.sum(), 63 - top), np.zeros(own.sum(), int))]
            for k in np.flatnonzero(many & (c[a] > 0)).tolist():
                i, j, depth = int(a[k]), int(z[k]), int(c[a[k]])
                bound = np.uint64((int(value[i]) << (64 - top)) | (int(q[i]) << (64 - top - depth)))
                m = j if p[i] == q[i] else i + int(np.searchsorted(key[i:j], bound))
                halves = (i, j, i, j) if p[i] == q[i] else (i, m, m, j)
                if m > i and (p[i] == q[i] or m < j):
                    starts.append(tuple(np.array([x]) for x in (*halves, 63 - top - depth, (int(p[i]) ^ int(q[i])).bit_count())))
            al, ah, bl, bh, bit, spent = (np.concatenate(x) for x in zip(*starts, strict=True))
            forest = Forest(len(key))
            for level in np.unique(bit)[::-1].tolist():
                at = bit == level
                trie_links(key, al[at], ah[at], bl[at], bh[at], errors, level, spent[at], forest)
            for i, j in forest.links:
                yield pa.record_batch([pa.array(node[i], pa.int64()), pa.array(node[j], pa.int64())], ["u", "v"])

    return groups.mapInArrow(joined, "u long, v long")


def near_duplicates(docs: DataFrame, errors: int = ERRORS, size: int = SHINGLE, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    fps = written(fingerprints(docs, size), docs)
    # A node is named by its fingerprint, which is free of nulls; the component's least doc_id names it in turn where there is one.
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), docs)
    found = components(links(distinct.select("fp", F.col("fp").alias("node")), errors, group_rows), docs)
    named = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id")).withColumnRenamed("component", "_component")
    named = named.join(least, F.col("component") == F.col("_component")).select(F.col("fp").alias("_fp"), "component_id")
    return fps.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def op10_simhash(spark, sf_dir):
    """op10's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return compact(found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"), docs)
