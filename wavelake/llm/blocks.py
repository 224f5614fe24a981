"""All pairs of a group's rows that are of unlike components, in cells of bounded size.

For groups whose like rows have been linked already: what is left to compare is each row against those
of other components. A group up to `group_rows` is one cell. A larger one is cut into blocks: of the
rows of its largest component, and of the others. Each block of the first meets each of the second, and those of
the second meet each other, so the work follows the rows that are not linked yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pairs that are looked at together.
PAIRS = 1 << 20
#: Parts of the hash space whose parities sketches have, and rows by size among which the nearest is looked for.
SKETCH, NEAR = 1024, 32
#: The columns that name a cell, after a group's keys; and those that meet() reads.
CELL = ["kind", "p", "q"]
TOLD = ["component", "main", "block"]


def unlike_cells(rows: DataFrame, keys: list[str], group_rows: int) -> DataFrame:
    """rows (keys, node, component, ...) of groups with several components, dealt to cells: with CELL, main and block."""
    sizes = rows.groupBy(*keys, "component").count()
    top = F.max(F.struct("count", "component"))
    mixed = sizes.groupBy(*keys).agg(top.alias("_t"), F.count("*").alias("_kinds"), F.sum("count").alias("_all")).where("_kinds > 1")
    mixed = mixed.select(*keys, F.col("_t.component").alias("_largest"), F.col("_t.count").alias("_d"), (F.col("_all") - F.col("_t.count")).alias("_o"))
    rows = rows.join(mixed, keys).withColumn("main", F.col("component") == F.col("_largest"))
    blocks = lambda c: f"cast(ceil({c} / {group_rows}) as int)"
    own = lambda c: f"cast(pmod(xxhash64(node), {blocks(c)}) as int)"
    cell = lambda k, p, q: f"named_struct('kind', {k}, 'p', {p}, 'q', {q})"
    cells = f"""case when _d + _o <= {group_rows} then array({cell(0, 0, 0)})
        when main then transform(sequence(0, {blocks('_o')} - 1), x -> {cell(1, own('_d'), 'x')})
        else concat(transform(sequence(0, {blocks('_d')} - 1), x -> {cell(1, 'x', own('_o'))}), transform(sequence(0, {blocks('_o')} - 1), x -> {cell(2, f"least(x, {own('_o')})", f"greatest(x, {own('_o')})")})) end"""
    kept = [c for c in rows.columns if not c.startswith("_")]
    return rows.selectExpr(*kept, f"{own('_o')} as block", f"explode({cells}) as _c").select(*kept, "block", *[f"_c.{c}" for c in CELL])


def meet(held: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether rows i and j of a cell are to be compared there: of unlike components, and in no other cell too."""
    kind, p, q, component, main, block = (held[c] for c in (*CELL, *TOLD))
    ok = component[i] != component[j]
    ok &= (kind[i] != 1) | (main[i] != main[j])
    return ok & ((kind[i] != 2) | (p[i] == q[i]) | (block[i] != block[j]))


def following(end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with i < j < end[i], so many at a time."""
    each = np.maximum(end - np.arange(len(end)) - 1, 0)
    upto = np.concatenate([[0], np.cumsum(each)])
    a = 0
    while a < len(end):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(a, z), each[a:z])
        yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[a:z] - upto[a], each[a:z])
        a = z


def distinct_pairs(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each (least, greatest) once."""
    u, v = np.minimum(u, v), np.maximum(u, v)
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    first = np.ones(len(u), bool)
    first[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[first], v[first]


def least_shared(m: np.ndarray | int, n: np.ndarray | int, share: int):
    """The least i for which 100 * i >= share * (m + n - i)."""
    return -(-share * (m + n) // (100 + share))


def sketches(h: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets a row of bytes: whether so many of its shingles as are in a part of the hash space are odd."""
    part = (h >> np.uint64(3)).astype(np.int64) & (SKETCH - 1)
    out = [np.zeros((0, SKETCH // 8), np.uint8)]
    for first in range(0, n, 256):
        a, z = np.searchsorted(of, [first, first + 256])
        counts = np.bincount((of[a:z] - first) * SKETCH + part[a:z], minlength=min(256, n - first) * SKETCH)
        out.append(np.packbits((counts & 1).astype(bool)).reshape(-1, SKETCH // 8))
    return np.concatenate(out)


def unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parities in which rows of sketches (as 64-bit words) differ: at most as many as shingles do."""
    return np.bitwise_count(a ^ b).sum(1, dtype=np.int64)


def words_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, SKETCH // 64)


_MET = "u long, v long, key long, n long, component long, sketch binary"


def _nearest(share: int, near: int, ends: bool):
    """Rows (key, n, node, component, sketch) in order -> each node and the nearest of the `near` before it that is of another component, if the pair may be alike.

    ends: also, with u = v, the first and last rows of the task, as many, for what goes on in other tasks.
    """
    names, none = [c.split()[0] for c in _MET.split(", ")], 1 << 40

    def run(batches):
        held, begun = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            new = [b.column(k).to_numpy() for k in range(4)] + [words_of(b.column(4).to_pylist())]
            old = 0 if held is None else len(held[0])
            key, n, node, component, sketch = new if held is None else (np.concatenate(x) for x in zip(held, new, strict=True))
            best, of = np.full(len(key), none), np.zeros(len(key), int)
            for w in range(1, min(near, len(key) - 1) + 1):
                gap = unlike(sketch[w:], sketch[:-w])
                gap[(key[w:] != key[:-w]) | (component[w:] == component[:-w])] = none
                better = gap < best[w:]
                best[w:][better], of[w:][better] = gap[better], w
            i = np.flatnonzero(best < none)
            i = i[i >= old]
            j = i - of[i]
            ok = best[i] <= n[i] + n[j] - 2 * least_shared(n[i], n[j], share)
            i, j = i[ok], j[ok]
            yield pa.record_batch([pa.array(node[i]), pa.array(node[j]), pa.array(key[i]), pa.array(n[i]), pa.array(component[i]), pa.nulls(len(i), pa.binary())], names)
            if ends and begun < near:
                yield end(key, n, node, component, sketch, slice(old, old + near - begun))
                begun += len(key) - old
            held = tuple(x[-near:] for x in (key, n, node, component, sketch))
        if ends and held is not None:
            yield end(*held, slice(None))

    def end(key, n, node, component, sketch, at):
        return pa.record_batch([pa.array(node[at]), pa.array(node[at]), pa.array(key[at]), pa.array(n[at]), pa.array(component[at]), pa.array([x.tobytes() for x in sketch[at]], pa.binary())], names)

    return run


def nearest(rows: DataFrame, parts: int, share: int) -> DataFrame:
    """(key, n, node, component, sketch) -> (u, v): for each row of a key the nearest by sketch, of another component, of the NEAR before it by size."""
    order = ["key", "n", "node"]
    found = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_nearest(share, NEAR, True), _MET)
    found = written(found, rows)
    # Where a key goes on in the next task, the last rows of one meet the first of the next: 2 * NEAR rows of a task.
    ends = found.where("sketch is not null").select("key", "n", F.col("u").alias("node"), "component", "sketch").dropDuplicates(["key", "node"])
    joints = ends.repartition(parts, "key").sortWithinPartitions(*order).mapInArrow(_nearest(share, NEAR, False), _MET)
    pairs = found.where("sketch is null").select("u", "v").unionAll(joints.select("u", "v"))
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
