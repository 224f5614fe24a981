"""Test of finding F7 of the third round."""

from __future__ import annotations

import numpy as np

from wavelake.llm import simhash


def test_f7_groups_beyond_a_task_lose_no_links(spark, monkeypatch):
    """Fingerprints that share nearly all bits, beyond what a task gathers: components are those of all pairs."""
    random = np.random.default_rng(7)
    # All share 34 high bits, so a split by the next bits parts nothing; then a dense cluster and scattered ones.
    base = 0x1234_5678_8000_0000
    keys = {base | int(v) for v in random.integers(0, 1 << 30, 500)}
    for centre in random.integers(0, 1 << 30, 12).tolist():
        keys |= {base | (centre ^ (1 << int(a)) ^ (1 << int(b))) for a, b in random.integers(0, 30, (40, 2))}
    keys = np.array(sorted(keys), np.uint64)
    monkeypatch.setattr(simhash, "GATHERED", 128)
    nodes = spark.createDataFrame([(int(k), n) for n, k in enumerate(keys.view(np.int64))], "fp long, node long")
    found = simhash.links(nodes, group_rows=64).collect()

    def components(pairs):
        root = list(range(len(keys)))

        def up(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in pairs:
            root[max(up(u), up(v))] = min(up(u), up(v))
        return [up(x) for x in range(len(keys))]

    near = np.argwhere(np.bitwise_count(keys[:, None] ^ keys[None, :]) <= 3)
    assert all(int(keys[r.u] ^ keys[r.v]).bit_count() <= 3 for r in found)
    assert components([(r.u, r.v) for r in found]) == components(near.tolist())


def test_f7_whole_groups_are_not_cut():
    import pyarrow as pa

    group = np.repeat([1, 2, 3], [10, 95, 5])
    batches = [pa.record_batch([pa.array(group[k : k + 10])], ["g"]) for k in range(0, len(group), 10)]
    seen = [set(c[0].tolist()) for c in simhash.whole_groups(iter(batches), ["g"], 1, 30)]
    assert sum(len(s) for s in seen) == 3
    assert len(list(simhash.whole_groups(iter(batches), ["g"], 1, 30, pieces=True))) > len(seen)
