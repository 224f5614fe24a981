import pytest

from wavelake.plans.filters import FilterError, compile_filter, filtered, parse

SCHEMA = (
    "number long, is_event boolean, event_kind string, event_text string, timestamp_us double, channel int, pdu_name string, adva string, adva_kind string, tx_add_random boolean, length int, payload binary, info string, crc_ok boolean, "
    "rssi_dbfs double, rssi_dbm double, snr_db double, gain_db int, temperature_c double, calibrated boolean, cluster_id int, anomaly_score double, alerts array<string>, n_antennas int, cfo_ppm double"
)
NAN = float("nan")


@pytest.fixture(scope="module")
def rows(spark):
    base = dict(is_event=False, event_kind="", event_text="", timestamp_us=2.5e6, channel=37, pdu_name="ADV_IND", adva="AA:BB:CC:DD:EE:FF", adva_kind="public", tx_add_random=False, length=30, payload=bytearray(b"\x01\xab"), info="Sensor", crc_ok=True, rssi_dbfs=-50.0, rssi_dbm=None, snr_db=20.0, gain_db=45, temperature_c=25.0, calibrated=False, cluster_id=-1, anomaly_score=0.2, alerts=[], n_antennas=1, cfo_ppm=5.0)
    made = [base, base | dict(crc_ok=False, rssi_dbfs=NAN, cfo_ppm=None, length=0), base | dict(channel=38, pdu_name="SCAN_RSP", alerts=["two separated feature clusters"], anomaly_score=4.0), base | dict(is_event=True, event_kind="retune", event_text="moved", crc_ok=False, adva="", rssi_dbfs=None)]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((r | {"number": i + 1})[k] for k in names) for i, r in enumerate(made)], SCHEMA)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("rssi > -60", {1, 3}), ("rssi != -50", {2, 4}), ("rssi == -50.0", {1, 3}), ("!(rssi > -60)", {2, 4}), ("rssi", {1, 3}), ("length", {1, 3, 4}), ("cluster", {1, 2, 3, 4}),
        ("crc == fail", {2, 4}), ("crc_ok", {1, 3}), ("crc_ok == 1", set()), ("crc_ok != 1", set()), ("crc_ok == yes", {1, 3}), ("crc_ok == 'no'", {2, 4}), ("crc_ok > true", set()), ("crc_ok == maybe", set()),
        ("adva == aa:bb:cc:dd:ee:ff", {1, 2, 3}), ("adva != aa:bb:cc:dd:ee:ff", {4}), ("adva contains 'dd:e'", {1, 2, 3}), ("adva < b", set()), ("adva ~ 'a.*b'", set()), ("rssi contains 50.0", {1, 3}),
        ("channel == 38 or channel == 37 and crc == fail", {2, 3, 4}), ("(channel == 38 or channel == 37) && crc == pass", {1, 3}), ("not crc_ok and not event", {2}), ("event == retune", {4}), ("info contains MOVE", {4}), ("info == sensor", {1, 2, 3}),
        ("alerts", {3}), ("anomaly > 3.5e0", {3}), ("payload == '01ab'", {1, 2, 3, 4}), ("time >= 2.5", {1, 2, 3, 4}), ("rssi == word", set()), ("rssi != word", {2, 4}), ("channel != word", set()), ("rssi > '-60'", {1, 3}), ("CHANNEL == 38", {3}), ("cfo_ppm <= 5", {1, 3, 4}), ("  ", {1, 2, 3, 4}),
    ],
)
def test_rows_let_through(rows, text, want):
    assert {r.number for r in filtered(rows, text).collect()} == want


@pytest.mark.parametrize("text", ["rssi >", "(rssi > 1", "nothing == 1", "rssi 5", "rssi > 1 )", "== 5", "rssi > > 5", "rssi @ 5", "and", "rssi > 1 or"])
def test_errors(text):
    with pytest.raises(FilterError):
        compile_filter(text)


def test_conditions_reach_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "p"))
    plan = filtered(spark.read.parquet(str(tmp_path / "p")), "channel == 38 && adva == 'aa:bb:cc:dd:ee:ff'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(channel,38)" in plan.replace(".0", "") or "EqualTo(adva,AA:BB:CC:DD:EE:FF)" in plan


def test_complement_and_text(rows):
    for text in ("rssi > -60", "alerts ~ two", "crc_ok == 1"):
        assert filtered(rows, text).count() + filtered(rows, f"!({text})").count() == 4
    assert parse("rssi > 1 && !crc_ok").describe() == "(rssi > 1 && !(crc_ok))"
