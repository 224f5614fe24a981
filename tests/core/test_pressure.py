"""Shedding and loss counters: by trigger, apart from each other, and the same after a repeat."""

import pytest
from pyspark.sql import functions as F

from wavelake.dsp.demod import Receiver, demodulate
from wavelake.dsp.measure import measure
from wavelake.dsp.synth import captures
from wavelake.streaming import pressure

ROWS = "session string, block_index long, crc_ok boolean"


def counts(d):
    return {(r.session, r.counter): r.n for r in d.collect()}


def test_rows_far_behind_their_sessions_newest_block_are_shed(spark):
    d = spark.createDataFrame([("a", k) for k in range(20)] + [(None, 5), (None, 7), ("b", None)], "session string, block_index long")
    got = {(r.session, r.block_index): (r.backlog, r.full) for r in pressure.with_backlog(d, 10).collect()}
    assert sorted(k for (s, k), (_, full) in got.items() if s == "a" and not full) == list(range(15))
    assert got["a", 14] == (0.5, False) and got["a", 15] == (0.4, True) and got[None, 5] == (0.2, True) and got["b", None] == (0.0, True)


def test_losses_are_counted_apart(spark):
    rows = [("s", 0, 0, 10, False, True), ("s", 1, 10, 10, False, True), ("s", 2, 20, 0, True, True), ("s", 3, 30, 10, False, True), ("s", 4, 45, 10, False, True), ("s", 5, 55, 0, False, True), ("s", 6, 65, 10, False, True), ("s", 7, 90, 10, False, False), ("s", 8, 100, 10, None, True), ("s", 9, 113, 10, False, True)]
    d = spark.createDataFrame(rows, "session string, block_index long, first_sample long, n_samples int, lapped boolean, timestamp_valid boolean")
    assert counts(pressure.block_counters(d)) == {("s", "blocks"): 10, ("s", "lapped"): 1, ("s", "empty"): 1, ("s", "missing"): 5 + 3}
    assert counts(pressure.block_counters(d.limit(0))) == {}


def feed(spark, path, rows):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(path)


def run(spark, base, capacity, work):
    stream = spark.readStream.schema(ROWS).parquet(f"{base}/in")
    pressure.shedding(stream, work, f"{base}/out", f"{base}/mark", capacity).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(pressure.COUNTERS).parquet(f"{base}/out/counters")


def test_a_growing_stream_counts_each_row_once(spark, tmp_path):
    base, work = str(tmp_path), lambda d: d.withColumnRenamed("full", "features_full")
    feed(spark, f"{base}/in", [("a", k, k % 4 != 0) for k in range(100)])
    first = counts(pressure.totals(run(spark, base, 20, work), rows=150))
    assert first == {("a", "packets"): 100, ("a", "shed"): 90, ("a", "failed_checks"): 25, ("a", "beyond_table"): 0}
    feed(spark, f"{base}/in", [("a", k, True) for k in range(100, 160)] + [("b", 1, False)])
    second = counts(pressure.totals(run(spark, base, 20, work), rows=150))
    assert second == {("a", "packets"): 160, ("a", "shed"): 140, ("a", "failed_checks"): 25, ("a", "beyond_table"): 10, ("b", "packets"): 1, ("b", "shed"): 0, ("b", "failed_checks"): 1, ("b", "beyond_table"): 0}
    assert counts(pressure.totals(run(spark, base, 20, work), rows=150)) == second  # nothing new
    # No row is dropped: what is shed is there, with the cheap figures only.
    assert spark.read.parquet(f"{base}/out/packets").count() == 161


def test_a_trigger_that_failed_is_repeated_without_rows_twice(spark, tmp_path):
    base, failed = str(tmp_path), []
    feed(spark, f"{base}/in", [("a", k, True) for k in range(30)])

    def work(d):
        if not failed:
            failed.append(d.withColumnRenamed("full", "features_full"))
            failed[0].write.parquet(f"{base}/out/packets/trigger=0")
            raise RuntimeError("lost")
        return d.withColumnRenamed("full", "features_full")

    with pytest.raises(Exception, match="lost"):
        run(spark, base, 20, work)
    assert counts(run(spark, base, 20, work))["a", "packets"] == 30 == spark.read.parquet(f"{base}/out/packets").count()


def test_pace_follows_observed_rates(spark, tmp_path):
    pace = pressure.Pace(seconds=10, first=50)
    assert pace.capacity() == 50
    for blocks, seconds in ((100, 1), (300, 1), (0, 5), (200, 1)):
        pace.saw(blocks, seconds)
    assert pace.capacity() == 2000
    feed(spark, f"{tmp_path}/in", [("a", k, True) for k in range(40)])
    fresh = pressure.Pace(seconds=1000, first=20)
    assert counts(run(spark, str(tmp_path), fresh, lambda d: d.withColumnRenamed("full", "features_full")))["a", "shed"] == 30
    assert len(fresh.rates) == 1 and fresh.capacity() > 20


def test_shed_packets_have_the_cheap_figures(spark):
    events = spark.createDataFrame([(k, k) for k in range(8)], "event_id long, user_id long")
    d = demodulate(captures(events), Receiver())
    marked = pressure.with_backlog(d, 2).cache()  # three blocks
    rows = measure(marked, full="full").collect()
    want = {(r.session, r.abs_sync): r.full for r in marked.select("session", "abs_sync", "full").collect()}
    assert {(r.session, r.abs_sync): r.features_full for r in rows} == want and set(want.values()) == {True, False}
    plain = {(r.session, r.abs_sync): r for r in measure(d).collect()}
    assert len(plain) == len(rows) == 8 and all(r.cfo_hz == plain[r.session, r.abs_sync].cfo_hz for r in rows)
    assert all(r == plain[r.session, r.abs_sync] for r in rows if r.features_full)
    assert marked.where(F.col("full")).count() < 8
