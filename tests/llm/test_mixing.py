from collections import defaultdict

import pytest

from wavelake.llm.mixing import keep_mix, min_cost_flow, mix, op7_mixing

from .conftest import SF, WORD


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by handing out the excess again and again."""
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    target = dict.fromkeys(sources, 0.0)
    left, free = float(sum(sizes.values())), set(sources)
    while left > 1e-9 and free:
        share = left / sum(w[s] for s in free)
        left = 0.0
        for s in list(free):
            target[s] += share * w[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def test_whole_table(spark, documents):
    rows = {r.doc_id: r for r in op7_mixing(spark, SF).collect()}
    assert len(rows) == len(documents)
    sizes = defaultdict(int)
    for _, t, s in documents:
        sizes[s] += len(WORD.findall(t or ""))
    target, taken, largest = filled(sizes), defaultdict(int), defaultdict(int)
    for i, t, s in documents:
        r = rows[i]
        assert r.size == len(WORD.findall(t or "")) and r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    assert rows == {r.doc_id: r for r in op7_mixing(spark, SF).collect()}


def test_capped_targets(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "p"), (2, "a " * 100, "q"), (3, "a " * 1000, None), (4, "a " * 40, "r")], "doc_id long, text string, source string")
    want = filled({"p": 10, "q": 100, "r": 40, None: 1000})
    got = {r.pattern[0]: r.target for r in mix(docs).collect()}
    assert {k: pytest.approx(v) for k, v in want.items()} == got and got["p"] == 30


def test_flow_shares_overlaps_and_repeats_last():
    sizes, members = {"x": 10, "y": 10, "xy": 10}, {"x": ("a",), "y": ("b",), "xy": ("a", "b")}
    flow = min_cost_flow(sizes, members, {"a": 18.0, "b": 12.0})
    assert sum(v for (p, s), v in flow.items() if s == "a") == pytest.approx(18) and sum(v for (p, s), v in flow.items() if s == "b") == pytest.approx(12)
    assert all(sum(v for (q, _), v in flow.items() if q == p) <= 10 + 1e-6 for p in sizes)  # no pattern is repeated while others are left
    assert sum(min_cost_flow(sizes, members, {"a": 500.0, "b": 500.0}).values()) == pytest.approx(90)


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, [["a"], ["b"], ["a", "b"], []][i % 4]) for i in range(400)], "doc_id long, text string, source array<string>")
    rows = mix(docs, {"a": 1500.0, "b": 1000.0}).collect()
    taken = defaultdict(int)
    for r in rows:
        taken[tuple(r.pattern)] += r.size * r.times
    assert taken[("a",)] + taken[("b",)] + taken[("a", "b")] == pytest.approx(2500, abs=30) and taken[()] == 0 and taken[("a",)] <= 1510


def test_odd_rows(odd):
    rows = mix(odd).collect()
    assert len(rows) == 9 and {r.size for r in rows if r.doc_id in (1, 2)} == {0} and mix(odd.limit(0)).count() == 0
    kept = keep_mix(odd)
    assert kept.columns == odd.columns and all(r.text for r in kept.collect())
