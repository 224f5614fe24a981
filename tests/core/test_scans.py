"""Scans and joins in ranges of an order: equal to plain loops, and no key is one task's work."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from wavelake.dsp.demod import folded_floor
from wavelake.operators import joins, windows


def _rows(spark, n=600, keys=("hot", "cold", None), step=3, seed=1):
    """Two thirds of the rows have one key; orders have holes of many blocks."""
    r = random.Random(seed)
    rows, at = [], dict.fromkeys(keys, -40)
    for _ in range(n):
        k = keys[0] if r.random() < 0.67 else r.choice(keys)
        at[k] += r.choice((1, 1, 2, step, 90))
        rows.append((k, at[k], r.choice((None, float("nan"), -1.0, *[r.uniform(0.1, 9) for _ in range(9)])), r.randrange(5)))
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i long, v double, e int")


def _by_key(rows):
    out = {}
    for row in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 10**6])
def test_followed_equals_the_fold(spark, size):
    rows, d = _rows(spark)
    found = {(r.k, r.i): r.x for r in windows.followed(d, {"x": F.col("v")}, "i", ["k"], 0.95, F.col("v") > 0, size).collect()}
    assert len(found) == len(rows)
    for k, own in _by_key(rows).items():
        want = folded_floor([float("nan") if r[2] is None else r[2] for r in own], alpha=0.05)
        assert [found[k, r[1]] if found[k, r[1]] is not None else 1e-9 for r in own] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("size", [5, 64])
def test_affine_scan_of_two_offsets(spark, size):
    rows, d = _rows(spark, seed=2)
    g, x, y = F.when(F.col("e") == 0, 0.0).otherwise(F.col("e") / 3), F.col("v"), F.col("i") * 1.0
    found = {(r.k, r.i): r for r in windows.affine_scan(d, g, {"x": x, "y": y}, "i", ["k"], size).collect()}
    for own in _by_key(rows).values():
        scale, p, q = 1.0, 0.0, 0.0
        for k, i, v, e in own:
            if v is not None:
                scale, p, q = scale * e / 3, p * e / 3 + v, q * e / 3 + i
            r = found[k, i]
            assert (r.scale, r.x, r.y) == pytest.approx((scale, p, q), rel=1e-9, nan_ok=True)
    one = spark.createDataFrame([(i, 2.0, 1.0) for i in range(10)], "i long, g double, o double")
    assert [(r.scale, r.z) for r in windows.affine_scan(one, F.col("g"), {"z": F.col("o")}, "i", size=3).orderBy("i").collect()] == [(2.0**n, 2.0**n - 1) for n in range(1, 11)]
    assert windows.affine_scan(one.limit(0), F.col("g"), {"z": F.col("o")}, "i").count() == 0


def test_followed_of_one_hot_session_is_many_tasks(spark):
    d = spark.range(20_000).select(F.lit("one").alias("s"), F.col("id").alias("i"), F.rand(3).alias("v"))
    blocks = d.withColumn("_block", F.floor(F.col("i") / 500)).groupBy("s", "_block").count()
    assert blocks.count() == 40 and blocks.agg(F.max("count")).first()[0] == 500
    last = windows.followed(d, {"x": F.col("v")}, "i", ["s"], size=500).orderBy(F.desc("i")).first().x
    want = None
    for r in d.orderBy("i").collect():
        want = r.v if want is None else 0.9 * want + 0.1 * r.v
    assert last == pytest.approx(want)


def test_ranges_equal_whole_windows(spark):
    _, d = _rows(spark, keys=("hot", "cold"), seed=4)
    same = lambda f, *a, **k: (lambda x, y: sorted(map(str, x.collect())) == sorted(map(str, y.select(*x.columns).collect())))(f(d, *a, **k), f(d, *a, **k, size=16))
    assert same(windows.gap_segments, ["k"], "i", "i", 3)
    assert same(windows.change_points, ["k"], "i", "v", 2.0)
    assert same(windows.change_points, ["k"], "i", "v", 2.0, epoch="e")
    assert same(windows.islands, ["k"], "i", "e", 3)
    whole, parts = windows.peak_hold(d.na.drop(), "k", "i", "v"), windows.peak_hold(d.na.drop(), "k", "i", "v", size=16)
    pair = whole.join(parts.select("k", "i", F.col("peak").alias("other")), ["k", "i"])
    assert pair.count() == d.na.drop().count() and pair.where("abs(peak - other) > 1e-9").count() == 0


def test_spans_that_reach_over_many_ranges(spark):
    r = random.Random(9)
    spans = [("a", s, s + r.choice((1, 2, 5))) for s in r.sample(range(3000), 300)] + [("a", 100, 900), ("a", 100, 900), ("a", 890, 1200), ("b", -50, 5), ("b", 5, 9), ("b", 10, 11)]
    d = spark.createDataFrame(spans, "k string, s long, e long")
    whole, parts = windows.merged_spans(d, ["k"], "s", "e"), windows.merged_spans(d, ["k"], "s", "e", size=10)
    found = sorted(map(tuple, parts.select("k", "s", "e").collect()))
    assert found == sorted(map(tuple, whole.select("k", "s", "e").collect())) and ("b", -50, 9) in found
    assert any(k == "a" and s <= 100 and e >= 1200 for k, s, e in found)


def test_previous_rows_over_empty_ranges(spark):
    d = spark.createDataFrame([(None, 1, "x"), (None, 1000, None), (None, 1001, "z"), ("k", 5, "y")], "k string, i long, v string")
    got = {(r.k, r.i): r._before and r._before.asDict() for r in windows.with_previous(d, ["i", "v"], "i", ["k"], 10).collect()}
    assert got == {(None, 1): None, (None, 1000): {"i": 1, "v": "x"}, (None, 1001): {"i": 1000, "v": None}, ("k", 5): None}


def _pairs(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if x[3] is not None and x[3] == y[3] and max(x[1], y[1]) < min(x[2], y[2]))


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_overlaps_of_short_and_very_long_spans(spark, bucket):
    r = random.Random(bucket)
    make = lambda n, base: [(base + i, s, s + r.choice((-1, 0, 1, 3, 40, 10**6 * bucket, 10**12)), r.choice(("h", "h", "h", "c", None))) for i, s in enumerate(r.randrange(-500, 500) for _ in range(n))]
    a, b = make(80, 0), make(90, 1000)
    # Repeated rows pair as often.
    a, b = [*a, a[0], (999, -(10**12), 10**12, "h")], [*b, b[3]]
    left, right = (spark.createDataFrame(x, "n long, start long, end long, k string") for x in (a, b))
    found = joins.overlapping(left, right, ["k"], bucket)
    assert sorted((x.n_a, x.n_b) for x in found.collect()) == _pairs(a, b)
    assert joins.overlapping(left.limit(0), right, ["k"], bucket).count() == 0 == joins.overlapping(left, right.limit(0), ["k"], bucket).count()


def test_a_span_of_a_million_buckets_is_few_rows(spark):
    spans = spark.createDataFrame([(3, 1_000_003), (-5, 10**12 + 1), (8, 9)], "s long, e long")
    sizes = [(r.s, r.e, r.n) for r in spans.select("s", "e", joins._nodes(F.col("s"), F.col("e"), 1).alias("n")).collect()]
    for s, e, nodes in sizes:
        # The nodes are apart and make up the span.
        parts = sorted((n.node << n.level, (n.node + 1) << n.level) for n in nodes)
        assert parts[0][0] == s and parts[-1][1] == e and all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
        assert len(parts) <= 2 * (e - s).bit_length()
