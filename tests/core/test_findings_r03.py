"""Tests of the findings of the third round, named by their numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wavelake.dsp import synth


def test_f1_one_step_serves_all_changes(spark, monkeypatch):
    """Packets of other addresses cost no further error functions, and tasks follow the events."""
    calls = []
    erf = synth.math.erf
    monkeypatch.setattr(synth.math, "erf", lambda v: calls.append(v) or erf(v))
    for k in range(8):
        x, first = synth.burst(synth.advertisement(bytes([k, 250, 1, 2, 3, 4])), synth.Transmitter())
    assert len(calls) < 200 and first == 640
    # A clock off by some ppm takes each change by itself; without an error to speak of both agree.
    near, _ = synth.burst(synth.advertisement(bytes([7, 250, 1, 2, 3, 4])), synth.Transmitter(clock_ppm=1e-7))
    n = min(len(x), len(near))
    assert np.abs(x[:n] - near[:n]).max() < 1e-3

    events = spark.range(40_000).select(F.col("id").alias("event_id"), F.col("id").alias("user_id"))
    assert synth.captures(events).rdd.getNumPartitions() == 5


def _sample_joins(df) -> list[str]:
    """Kinds of the joins that have samples on either side."""
    out, todo = [], [df._jdf.queryExecution().sparkPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if "Join" in node.nodeName():
            names = [a for k in range(2) for a in node.children().apply(k).output().mkString(",").split(",")]
            if any(n.startswith(("iq#", "_tail")) for n in names):
                out.append(node.nodeName())
    return out


def test_f2_f3_f4_blocks_are_not_broadcast(spark):
    """However small Spark takes made-up blocks to be, no join collects their samples in the driver."""
    from wavelake.dsp.blocks import balanced, block_figures
    from wavelake.dsp.demod import Receiver, demodulate
    from wavelake.plans.capture import packet_rows

    blocks = synth.captures(spark.range(70).select(F.col("id").alias("event_id"), F.col("id").alias("user_id")))
    for d in (demodulate(blocks, Receiver()), block_figures(blocks, 8e6), balanced(blocks), packet_rows(blocks)):
        joins = _sample_joins(d)
        assert joins and set(joins) == {"SortMergeJoin"}, joins


def test_f5_offsets_beyond_four_digits(spark):
    from wavelake.functions.bytes import hex_dump

    d = spark.range(1).select("id", F.expr("cast(repeat('a', 70000) as binary)").alias("data"))
    lines = {r.line: r.text[:7] for r in hex_dump(d, "data", "id").collect()}
    assert lines[0] == "0000  6" and lines[4095] == "fff0  6" and lines[4096] == "10000  " and len(lines) == 4375


def test_f6_cells_round_as_sql_does(spark):
    """Ties to the even digit, by the number itself and not by its shortest decimal."""
    from wavelake.functions.scalars import cell

    random = np.random.default_rng(6)
    ties = [k / 2 for k in range(-9, 10)] + [k / 1000 for k in range(-999, 1000, 5)] + [k / 10000 + m for k in range(5, 10000, 35) for m in (0, 1, 257123358)]
    near = [257123358.5, 0.0, -0.0, -0.04, 1e-300, 0.99951, 9.9995, 1e15 + 0.5, 2.0**52 - 0.5, 2.0**60, -(2.0**53), *random.normal(size=500) * 10.0 ** random.integers(-5, 12, 500)]
    d = spark.createDataFrame([(float(x),) for x in ties + near] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    for r in d.select("x", *[cell(F.col("x"), k).alias(f"d{k}") for k in range(4)]).collect():
        for k in range(4):
            assert r[f"d{k}"] == (f"{r.x:.{k}f}" if r.x is not None and np.isfinite(r.x) else ""), (r, k)


def test_f11_spans_met_without_pairs(spark):
    """Spans met by many others come once, by no join of the two sides."""
    from wavelake.operators.joins import met

    random = np.random.default_rng(11)
    sides = []
    for n, longest in ((400, 60), (60, 40)):
        start = random.integers(-200, 800, n)
        sides.append([(int(k), int(s), int(s + w)) for k, s, w in zip(random.integers(0, 3, n), start, random.integers(-1, longest, n), strict=True)])
    a, b = sides
    rows = [*a, *a[:5]]  # rows that are equal stay apart
    left, right = (spark.createDataFrame([*side, (None, 0, 100)], "channel int, start long, end long") for side in (rows, b))
    want = sorted((k, s, e) for k, s, e in rows if s < e and any(k == m and x < y and x < e and s < y for m, x, y in b))
    for size in (7, 100, 1e6):
        d = met(left, right, ["channel"], size)
        assert sorted(map(tuple, d.collect())) == want
    crowd = spark.range(3000).selectExpr("1 channel", "id start", "id + 5000 end")
    assert met(crowd, crowd, ["channel"], 500).count() == 3000
    import __spark_entry__

    d = __spark_entry__.queries()["interval_overlap"](spark, "/root/testdata/sf0.001")
    assert "explode" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_f10_last_spectra_without_gathering_a_session(spark):
    from wavelake.plans.charts import waterfall

    blocks = spark.range(60).selectExpr("'s' session", "0 epoch", "id block_index", "2.4e9D frequency_hz", "1 n_channels", "if(id >= 57, X'00', unhex(repeat(hex(cast(id + 1 as string)), 32))) iq")
    blocks = blocks.withColumn("iq", F.expr("if(block_index >= 57, iq, substr(iq, 1, 32))"))
    d = waterfall(blocks, 8e6, rows=5, size=8)
    found = {r.block_index for r in d.collect()}
    assert found == {52, 53, 54, 55, 56} and d.count() == 40  # the last blocks with a spectrum
    # One window, over a row for each of the last blocks.
    assert d._jdf.queryExecution().optimizedPlan().toString().count("windowspecdefinition") == 1


def test_f9_items_of_a_few_payloads_at_a_time(spark):
    """Whatever an Arrow batch holds, items of a megabyte of payloads (or of one) are held at a time."""
    import pandas as pd

    from wavelake.functions import bytes as B

    payload = bytes([2, 1, 6]) * 40_000
    batch = pd.Series([payload, None, b"", payload, payload * 20, *[payload] * 30])
    parts = list(B.parse_ad.func(iter([batch, pd.Series([], dtype=object)])))
    sizes = [sum(len(x or b"") for x in batch[p.index]) for p in parts if len(p)]
    assert len(sizes) > 5 and sorted(sizes)[-2] <= B.PARSED_BYTES and sum(len(p) for p in parts) == len(batch)
    assert [None if x is None else len(x) for p in parts for x in p][:5] == [40_000, None, 0, 40_000, 800_000]
    d = spark.range(50, numPartitions=1).select("id", F.expr("unhex(repeat('020106', cast(id * 1000 as int)))").alias("data"))
    assert [r.n for r in d.select("id", F.size(B.parse_ad("data")).alias("n")).orderBy("id").collect()] == [k * 1000 for k in range(50)]


def test_f8_long_spans_are_few_rows(spark):
    """Spans of thousands of buckets, and points, are dealt to few nodes; pairs are all found."""
    from wavelake.operators.joins import _begun_within, overlapping

    a = spark.range(300).selectExpr("1 k", "id * 1000 start", "id * 1000 + 5000 + id % 7 * 100 end", "id n")
    b = spark.range(200).selectExpr("1 k", "id * 1400 + 3 start", "id * 1400 + 2500 end", "id n")
    left, right = ([tuple(r) for r in d.select("start", "end", "n").collect()] for d in (a, b))
    want = sorted((n, m) for s, e, n in left for x, y, m in right if s < y and x < e)
    d = overlapping(a, b, ["k"], 1)
    assert sorted((r.n_a, r.n_b) for r in d.collect()) == want
    spans, points = (d.withColumnsRenamed({c: f"{c}_{side}" for c in ("start", "end", "n")}) for d, side in ((a, "a"), (b, "b")))
    plan = _begun_within(spans, points, ["k"], ("start_a", "end_a"), "start_b", 1)._jdf.queryExecution().analyzed()
    seen, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Join":
            from pyspark.sql import DataFrame

            seen = [DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().apply(k)), spark).count() for k in range(2)]
    assert seen and seen[0] <= 4 * 300 and seen[1] <= 4 * 200, seen
