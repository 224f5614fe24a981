import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import __main__ as cli
from wavelake.dsp import blocks as B
from wavelake.dsp.demod import Receiver, packets
from wavelake.dsp.measure import Burst
from wavelake.dsp.synth import Transmitter, advertisement, blocks, burst, crc24, stream
from wavelake.functions.register import register
from wavelake.operators import windows
from wavelake.plans.capture import analyze, controlled, numbered, retune_events, tuned
from wavelake.constants import VECTOR

LEGIT = dict(cfo_hz=18e3, modulation_index=0.505, bt=0.5, ramp_us=2.0, drift_hz=6e3)
SPOOF = dict(cfo_hz=-24e3, modulation_index=0.478, bt=0.44, ramp_us=3.4, drift_hz=-11e3)


@pytest.fixture(scope="module")
def measured(spark):
    """Packets of one address from two transmitters, and of another from one."""
    packet, r, rows, random = advertisement(bytes(range(1, 7)), bytes.fromhex("020106") + b"\x09\x09sensor-1" + bytes(12)), Receiver(), [], np.random.default_rng(0)
    for k in range(180):
        adva = "AA" if k % 2 else "BB"
        t = SPOOF if adva == "AA" and k % 4 == 1 else LEGIT
        x, _ = burst(packet, Transmitter(**t, snr_db=random.uniform(22, 34)), seed=k)
        f = packets(x, r, gate=False)[0]
        m, _, profile = Burst(x[f.start : f.end], r.sample_rate, f.sync - f.start, f.offset, f.bits, f.levels).all()
        value = {v: float(m[v][0]) if np.isfinite(m[v][0]) else None for v in VECTOR}
        rows.append((k + 1, adva, False, True, k * 100_000.0, 25.0 + k % 4, -50.0 - k % 13, profile.tolist(), [], *value.values()))
    return spark.createDataFrame(rows, "number long, adva string, is_event boolean, crc_ok boolean, timestamp_us double, temperature_c double, rssi_dbfs double, profile array<float>, alerts array<string>, " + ", ".join(f"{v} double" for v in VECTOR)).cache()


def test_two_transmitters_behind_one_address(spark, measured):
    found = analyze(measured, enroll=("bb",)).cache()
    assert found.count() == 180
    assert found.groupBy("adva").agg(F.count_distinct("cluster_id").alias("n")).where("n between 1 and 4").count() == 2
    assert found.where("adva = 'BB' and anomaly_score is not null").count() == 81 and found.where("adva = 'AA' and anomaly_score is not null").count() == 0
    # A baseline counts the packets so far: no score before the tenth, no alert before it is valid.
    bb = found.where("adva = 'BB'").orderBy("number").collect()
    enrolled = lambda r: any("enrolled baseline" in a for a in r.alerts)
    assert not any(map(enrolled, bb))
    strict = analyze(measured.withColumn("calibrated", F.lit(True)), enroll=("BB",), threshold=0.1, needed=(40, 2, 2)).where("adva = 'BB'").orderBy("number").collect()
    assert [enrolled(r) for r in strict] == [False] * 39 + [True] * 51
    aa = [r for r in found.where("adva = 'AA'").orderBy("number").collect()]
    modes = [k + 1 for k, r in enumerate(aa) if any("two modes" in a for a in r.alerts)]
    assert modes and set(modes) <= {64, 80}
    kinds = ["two separated", "two modes", "at once", "enrolled baseline", "delay profile"]
    for r in aa + strict:
        order = [next(k for k, text in enumerate(kinds) if text in a) for a in r.alerts]
        assert order == sorted(order)
    split = {r.adva: r for r in windows.bimodal(measured, VECTOR).collect()}
    assert split["AA"].alert and not split["BB"].alert and split["AA"].key in ("cfo_ppm", "drift_hz", "drift_rate", "rise_time_us", "modulation_index")


def test_receiver_balance_is_taken_out(spark):
    random = np.random.default_rng(2)
    i, q = random.normal(size=(2, 65_536)) * 0.1
    x = (i * 1.1 + 0.02 + 1j * (q - 0.03)).astype(np.complex64)
    made = blocks(spark, x, size=4096)
    rows = B.balanced(made).orderBy("block_index").collect()
    from wavelake.dsp.signal import samples

    after = B.balance(np.concatenate([samples(bytes(r.iq)) for r in rows]))
    assert len(rows) == 16 and abs(after["dc"]) < 3e-3 and after["gain"] == pytest.approx(1, abs=0.02)


def test_retunes(spark):
    made = blocks(spark, np.zeros(16_384 * 4, np.complex64)).withColumn("wall_time", F.col("block_index").cast("double"))
    plan = spark.createDataFrame([("s", 0.0, 37, 2.402e9), ("s", 2.0, 38, 2.426e9)], "session string, effective_from double, channel int, frequency_hz double")
    assert [(r.channel, r.epoch) for r in tuned(made, plan).orderBy("block_index").collect()] == [(37, 0), (37, 0), (38, 1), (38, 1)]
    assert retune_events(plan).orderBy("wall_time").collect()[1].event_text == "retuned to channel 38 (2426 MHz)"


def test_commands_and_numbers(spark):
    made = blocks(spark, np.zeros(16_384 * 6, np.complex64)).withColumn("wall_time", F.col("block_index").cast("double"))
    commands = spark.createDataFrame([("s", 1.0, "gain", 30), ("s", 2.0, "clear", None), ("s", 4.0, "clear", None), ("s", 4.5, "gain", 20)], "session string, effective_from double, kind string, gain_db int")
    assert [(r.gain_db, r.counter) for r in controlled(made, commands).orderBy("block_index").collect()] == [(45, 0), (30, 0), (30, 1), (30, 1), (30, 2), (20, 2)]
    rows = [("s", e, k * 700) for e in (0, 1) for k in range(40)] + [("t", 0, 5)]
    found = numbered(spark.createDataFrame(rows, "session string, epoch int, sample_index long"), span=1000).orderBy("session", "epoch", "sample_index").collect()
    assert [r.number for r in found] == [*range(1, 81), 1]


def test_sql_functions(spark):
    names = register(spark)
    packet = advertisement(bytes(range(1, 7)), bytes.fromhex("03094142"))
    spark.createDataFrame([(bytearray(packet), 37)], "p binary, c int").createOrReplaceTempView("one_packet")
    r = spark.sql("SELECT crc24(substr(p, 1, octet_length(p) - 3)) AS crc, dewhiten(dewhiten(p, c), c) AS back, channel_to_freq(c) AS hz, format_address(substr(p, 3, 6)) AS a, is_advertising(c) AS adv, floor_bin(-50D, 3D) AS b, finite(double('NaN')) AS f FROM one_packet").first()
    assert (r.crc, bytes(r.back), r.hz, r.a, r.adv, r.b, r.f) == (crc24(packet[:-3]), packet, 2.402e9, "06:05:04:03:02:01", True, -51.0, None)
    assert spark.sql("SELECT value FROM one_packet, LATERAL ad_items(substr(p, 9, 4))").first()[0] == "AB" and "parse_ad" in names


def test_command_line(spark, tmp_path, capsys):
    made = [(advertisement(bytes([k % 2, 2, 3, 4, 5, 0xC6]), bytes([2, 1, 6])), Transmitter(snr_db=30)) for k in range(12)]
    blocks(spark, stream(made, seed=2)[0]).write.parquet(str(tmp_path / "b"))
    assert cli.main(["--blocks", str(tmp_path / "b"), "--out", str(tmp_path / "o"), "--filter", "crc == pass", "--no-spectra"]) == 0
    out = capsys.readouterr().out
    assert "packets 12" in out and "C6:05:04:03:02:01" in out and (tmp_path / "o.pcap").stat().st_size > 24 and (tmp_path / "o.json").exists()
    assert cli.main(["--join", str(tmp_path / "o.csv"), str(tmp_path / "o.parquet")]) == 0
    with pytest.raises(ValueError):
        cli.main(["--channel", "5", "--packets", "x"])
