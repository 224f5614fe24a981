import datetime
import hashlib
import json

import pytest

from jobs import common, payload_register, session_days

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_sources_import_no_text_operators():
    from pathlib import Path

    for path in Path(common.__file__).parent.glob("*.py"):
        assert "llm" not in path.read_text() and "corpus_pipeline" not in path.read_text()


# -- session_days ------------------------------------------------------------------------------


def test_session_days_runs_again_and_by_days(spark, tmp_path):
    config = {"events": f"{SF}/events.parquet", "out": str(tmp_path / "days"), "filter": "crc == pass"}
    first = rows(session_days.run(spark, config))
    assert first and rows(session_days.run(spark, config)) == first
    days = sorted({r[-1] for r in first})
    # Some days alone: these are made again, the others stay as they are.
    some = rows(session_days.run(spark, config | {"first_day": str(days[3]), "last_day": str(days[5])}))
    assert some == [r for r in first if days[3] <= r[-1] <= days[5]]
    assert rows(spark.read.parquet(f"{config['out']}/differences")) == first


def test_session_days_against_plain_means(spark, tmp_path):
    day = datetime.datetime(2024, 1, 2)
    table = [(i, day + datetime.timedelta(hours=20 * (i % 2)), 5 + i % 3, "view", float(i), "{}") for i in range(300)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(table, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(path)
    got = rows(session_days.run(spark, {"events": path, "out": str(tmp_path / "out")}))
    sums = {}
    for i, ts, user, _, value, _ in table:
        if i % 7 and i % 11:
            sums.setdefault((ts.date(), f"C0:DE:00:00:00:{user:02X}", 37 + i % 3), []).append(-90 + value / 7)
    want = []
    for (d, a, c), x in sums.items():
        for (d2, a2, c2), y in sums.items():
            if (d, a) == (d2, a2) and c < c2:
                want.append((a, c, c2, pytest.approx(sum(x) / len(x) - sum(y) / len(y), abs=2e-6), len(x), len(y), d))
    assert len(got) == len(want) and all(g in want for g in got)


def test_session_days_of_nothing(spark, tmp_path):
    config = {"events": f"{SF}/events.parquet", "out": str(tmp_path / "none"), "filter": "crc_ok == 1"}
    assert session_days.run(spark, config).count() == 0  # a filter that no packet passes
    assert session_days.run(spark, config | {"filter": "", "last_day": "1999-01-01"}).count() == 0


# -- payload_register --------------------------------------------------------------------------


def plain(texts):
    """The register of (doc_id, text, source) rows, but for checks and buckets."""
    out = {}
    for i, t, s in texts:
        own = out.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), {"n": 0, "by": set(), "first": None, "bytes": len((t or "").encode())})
        own["n"] += 1
        own["by"].add(s or "")
        at = (i is None, i or 0, s or "", i)
        own["first"] = at if own["first"] is None else min(own["first"], at)
    return sorted((d, o["bytes"], o["n"], len(o["by"]), o["first"][3], o["first"][2], len(o["by"]) > 1) for d, o in out.items())


def found(df):
    return sorted(tuple(r) for r in df.select("digest", "n_bytes", "transmissions", "transmitters", "first_doc_id", "first_source", "shared").collect())


def arrive(spark, path, texts):
    spark.createDataFrame(texts, payload_register.TEXTS).write.mode("append").parquet(path)


def test_register_takes_only_what_is_new(spark, tmp_path, caplog):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    one = [(5, "a", "x"), (6, "b", "x"), (7, None, "y"), (8, "ä" * 300, None)]
    two = [(3, "a", "y"), (9, "", "z"), (None, "b", None), (10, "c", "x"), (10, "c", "x")]
    config = {"texts": texts, "out": out, "buckets": 4, "files_per_batch": 1}
    arrive(spark, texts, one)
    assert found(payload_register.run(spark, config)) == plain(one)
    assert found(payload_register.run(spark, config)) == plain(one)  # nothing new
    before = spark.read.parquet(f"{out}/payloads").agg({"batch": "max"}).first()[0]
    arrive(spark, texts, two)
    with caplog.at_level("INFO", "jobs"):
        assert found(payload_register.run(spark, config)) == plain(one + two)
    assert any(f"took {len(two)} texts" in r.getMessage() for r in caplog.records)
    sent = spark.read.parquet(f"{out}/payloads")
    assert sent.where(sent.batch <= before).count() == len(one) and sent.where(sent.batch > before).count() == len(two)
    # All at once gives the same register.
    assert found(payload_register.run(spark, config | {"out": str(tmp_path / "again")})) == plain(one + two)


def test_register_survives_a_batch_that_failed(spark, tmp_path, monkeypatch):
    texts, out = str(tmp_path / "texts"), str(tmp_path / "out")
    one = [(i, f"t{i % 5}", "xy"[i % 2]) for i in range(20)]
    arrive(spark, texts, one)
    config = {"texts": texts, "out": out, "buckets": 3}
    real = payload_register.register

    def fails(sent):
        raise RuntimeError("lost")

    monkeypatch.setattr(payload_register, "register", fails)  # payloads are written, the register isn't
    with pytest.raises(Exception, match="lost"):
        payload_register.run(spark, config)
    assert spark.read.parquet(f"{out}/payloads").count() == 20
    monkeypatch.setattr(payload_register, "register", real)
    assert found(payload_register.run(spark, config)) == plain(one)
    assert spark.read.parquet(f"{out}/payloads").count() == 20


def test_register_of_no_files_and_checks(spark, tmp_path):
    from wavelake.functions import bytes as B
    from pyspark.sql import functions as F

    texts = str(tmp_path / "texts")
    (tmp_path / "texts").mkdir()
    config = {"texts": texts, "out": str(tmp_path / "out")}
    assert payload_register.run(spark, config).count() == 0
    many = [(i, "é" * n, "s") for i, n in enumerate((0, 1, 127, 128, 129, 255, 256, 257, 600))]
    arrive(spark, texts, many)
    got = {r.n_bytes: r.crc for r in payload_register.run(spark, config).collect()}
    folded = spark.createDataFrame(many, payload_register.TEXTS).select(F.octet_length("text").alias("n"), B.crc24(B.byte_array(F.col("text").cast("binary"))).alias("crc"))
    assert got == {r.n: r.crc for r in folded.collect()}


def test_command_line(spark, tmp_path, monkeypatch):
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"events": f"{SF}/events.parquet", "out": "?", "filter": "crc == pass"}))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the test's own session goes on
    assert common.main("a job", session_days.run, ["--config", str(config), "--set", f"out={tmp_path}/out", "--set", "digits=3"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out/strengths").count() > 0
