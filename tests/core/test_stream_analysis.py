import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake.constants import VECTOR
from wavelake.plans.capture import analyze
from wavelake.streaming import queries as streams
from wavelake.streaming.analysis import RESET, Moments, analysis, rocksdb

SCHEMA = "session string, number long, adva string, is_event boolean, event_kind string, crc_ok boolean, timestamp_us double, temperature_c double, rssi_dbfs double, calibrated boolean, profile array<float>, alerts array<string>, " + ", ".join(f"{k} double" for k in VECTOR)
HOW = {"enroll": ("aa", "BB"), "threshold": 1.1, "needed": (20, 3, 2)}


def told(n, sessions="xy", seed=0):
    """Packets of two addresses in each session: AA is two transmitters, BB leaps in its profile; some wrong checks, events and gaps."""
    random, rows = np.random.default_rng(seed), []
    for s in sessions:
        for k in range(n):
            a = "AA" if k % 2 else "BB"
            v = random.normal(0, 1, len(VECTOR)) * (0.2 if a == "AA" else 1) + (4.0 * (k % 4 == 1) if a == "AA" else 0)
            value = [None if (k + i) % 23 == 0 else float(x) for i, x in enumerate(v)]
            profile = [float(x) for x in random.normal(0, 0.01, 8) + (3 if a == "BB" and k % 90 == 88 else 0)]
            bad = k % 13 == 5
            rows.append((s, k + 1, a, k % 31 == 7, "note" if k % 31 == 7 else None, not bad, k // 50 * 3e6 + k % 50 * (2000.0 if k % 50 < 12 else 40_000.0), 20.0 + k % 5, -50.0 - k % 13, k % 3 == 0, profile if k % 17 else None, [], *value))
    return rows


def written(spark, path, rows, files):
    for part in np.array_split(np.arange(len(rows)), files):
        spark.createDataFrame([rows[i] for i in part], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # file times order the triggers


def run(spark, path, out, checkpoint, **how):
    stream = analysis(streams.packet_stream(spark, path, spark.read.parquet(path).schema, 2), **how)
    with rocksdb(spark):
        w = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        if "ttl_ms" in how:  # state that ends by the clock keeps a query running for good
            q, n = w.start(), spark.read.parquet(path).count()
            until = time.time() + 40
            while time.time() < until and (not os.path.isdir(out + "/_spark_metadata") or spark.read.schema(stream.schema).parquet(out).count() < n):
                time.sleep(0.3)
            q.stop()
        else:
            w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


COLUMNS = ["session", "number", "adva", "crc_ok", "cluster_id", "separation", "anomaly_score", "anomaly_contributions", "alerts"]


def plain(df):
    out = {}
    for r in df.select(*COLUMNS).collect():
        assert (r.session, r.number) not in out
        out[r.session, r.number] = (r.adva, r.crc_ok, r.cluster_id, r.alerts, [r.separation, r.anomaly_score, *sorted((r.anomaly_contributions or {}).items())])
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, (*exact, numbers) in want.items():
        assert got[k][:-1] == tuple(exact), k
        assert len(got[k][-1]) == len(numbers)
        for a, b in zip(got[k][-1], numbers, strict=True):
            if isinstance(b, tuple):
                assert a[0] == b[0]
                a, b = a[1], b[1]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-6, abs=1e-9)), k


def test_stream_equals_batch_over_two_sessions(spark, tmp_path):
    """All alerts, over several triggers and a restart from the checkpoint."""
    rows = sorted(told(360), key=lambda r: r[1])
    src, out, mark = (str(tmp_path / k) for k in ("in", "out", "mark"))
    batch = analyze(spark.createDataFrame(rows, SCHEMA), **HOW)
    assert batch.count() == len(rows)
    want = plain(batch)
    texts = " ".join(a for v in want.values() for a in v[3])
    assert [part for part in ("two separated", "at once", "enrolled baseline", "delay profile") if part not in texts] == []
    written(spark, src, rows[:400], 3)
    run(spark, src, out, mark, **HOW)
    written(spark, src, rows[400:], 2)
    same(plain(run(spark, src, out, mark, **HOW)), want)


def test_sessions_do_not_mix(spark):
    """Three sessions at once give each session's own rows: as many as packets."""
    rows = told(120, "pqr")
    every = plain(analyze(spark.createDataFrame(rows, SCHEMA), **HOW))
    assert len(every) == len(rows)
    one = plain(analyze(spark.createDataFrame([r for r in rows if r[0] == "q"], SCHEMA), **HOW))
    same({k: v for k, v in every.items() if k[0] == "q"}, one)


def test_reset_starts_a_session_anew(spark, tmp_path):
    first, second = told(100, "x", 1), [(r[0], r[1] + 200, *r[2:]) for r in told(100, "x", 2)]
    control = ("x", 150, None, True, RESET, False, 0.0, None, None, None, None, [], *[None] * len(VECTOR))
    src = str(tmp_path / "in")
    written(spark, src, first + [control] + second, 1)
    got = plain(run(spark, src, str(tmp_path / "out"), str(tmp_path / "mark"), **HOW))
    assert got.pop(("x", 150))[2] is None
    want = plain(analyze(spark.createDataFrame(first, SCHEMA), **HOW)) | plain(analyze(spark.createDataFrame(second, SCHEMA), **HOW))
    same(got, want)


def test_state_that_is_silent_is_dropped(spark, tmp_path):
    src, out, mark = (str(tmp_path / k) for k in ("in", "out", "mark"))
    written(spark, src, told(60, "x"), 1)
    run(spark, src, out, mark, ttl_ms=200)
    time.sleep(0.5)
    later = [(r[0], r[1] + 100, *r[2:]) for r in told(60, "x", 5)]
    written(spark, src, later, 1)
    got = plain(run(spark, src, out, mark, ttl_ms=200))
    same({k: v for k, v in got.items() if k[1] > 100}, plain(analyze(spark.createDataFrame(later, SCHEMA))))


def test_moments_go_on():
    x = np.random.default_rng(0).normal(1e6, 1, (50, 3))
    x[::7, 1] = np.nan
    a, b = Moments(3), Moments(3)
    whole, parts = a.add(x), []
    for k in range(0, 50, 8):
        parts.append(b.add(x[k : k + 8]))
        b = Moments(3, *b.state())
    for i in (1, 2):
        np.testing.assert_allclose(np.concatenate([p[i] for p in parts]), whole[i], rtol=1e-7)
    assert whole[2][-1, 0] == pytest.approx(x[:, 0].std(ddof=1))
