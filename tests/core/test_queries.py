"""Every named query against its SQL, run by DuckDB over the same tables."""

import math

import duckdb
import pytest

from wavelake.dsp.synth import crc24
from wavelake.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_without_sql(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def odd_texts(spark, tmp_path_factory):
    """Texts beyond 40 bytes, short ones, null and empty, as a documents table."""
    at = str(tmp_path_factory.mktemp("odd_texts"))
    texts = ["plain words of a text that goes on and on, " * k for k in (1, 3, 20, 4000)] + ["", None, "ab", "é" * 300, "tiny\x00" + "x" * 200]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, {i: None if t is None else t.encode() for i, t in enumerate(texts)}


def test_advertising_items_of_whole_texts(spark, odd_texts):
    at, texts = odd_texts
    want = set()
    for i, data in texts.items():
        k = place = 0
        while data and k < len(data) and data[k]:
            whole = k + 1 + data[k] <= len(data)
            want.add((i, place, data[k + 1] if whole else None, not whole))
            k, place = k + 1 + data[k], place + 1
    rows = QUERIES["advertising_items"](spark, at).collect()
    assert {(r.doc_id, r.place, r.type, r.truncated) for r in rows} == want and len(rows) == len(want) > 1000


def test_packets_of_whole_texts(spark, odd_texts):
    at, texts = odd_texts
    rows = {r.doc_id: r for r in QUERIES["parsed_packets"](spark, at).collect()}
    assert len(rows) == len(texts)
    for i, data in texts.items():
        if data is not None:
            assert rows[i].ok == (len(data) >= 5 and data[1] + 5 <= len(data))
            assert rows[i].crc_ok == (rows[i].ok and int.from_bytes(data[data[1] + 2 : data[1] + 5], "little") == crc24(data[: data[1] + 2]))
    assert rows[2].ok and rows[3].ok and not rows[0].ok


def test_captures_hold_every_event(spark, tmp_path):
    users = {k: [70_000, 3, 255, 256][k % 4] + k // 4 for k in range(150)}
    rows = [(k, u) for k, u in users.items()] + [(7, 1000)] * 70 + [(None, None)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(f"C0:DE:00:00:{u // 256 % 256:02X}:{u % 256:02X}" for u in ((r[1] or 0) for r in rows))
    found = QUERIES["measured_capture"](spark, str(tmp_path)).collect()
    assert sorted(r.adva for r in found) == want and all(r.crc_ok for r in found)
    assert len({(r.session, r.number) for r in found}) == len(rows) == QUERIES["demodulated_capture"](spark, str(tmp_path)).count()
    for name in ("interference_blocks", "receiver_calibration"):
        assert {r.session for r in QUERIES[name](spark, str(tmp_path)).select("session").distinct().collect()} == {r.session for r in found}
