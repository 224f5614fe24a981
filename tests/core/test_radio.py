"""The path from samples to measured, analysed packets, on packets made from known parameters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelake import constants as C
from wavelake.dims import channel_mhz, keystream
from wavelake.dsp import blocks as B
from wavelake.dsp import signal as S
from wavelake.dsp.demod import Receiver, demodulate, packets, peaks, spans
from wavelake.dsp.measure import Burst, settled
from wavelake.dsp.synth import Transmitter, advertisement, blocks, burst, crc24, stream
from wavelake.plans.capture import numbered, packet_rows

ADDRESS = bytes.fromhex("665544332211")
PACKET = advertisement(ADDRESS, bytes.fromhex("020106") + b"\x09\x09" + b"sensor-1" + bytes(range(10)))


def measured(t, full=True, seed=3, **more):
    x, start = burst(PACKET, t, seed=seed)
    r = Receiver()
    found = packets(x, r, gate=False)
    assert len(found) == 1
    f = found[0]
    return Burst(x[f.start : f.end], r.sample_rate, f.sync - f.start, f.offset, f.bits, f.levels, full=full, **more).all()[0]


def test_fixed_vectors():
    assert [keystream(c, 8).hex() for c in (37, 38, 39, 0)] == ["8dd257a13da766b0", "d6c5442059dee18f", "1f374a5f85f69c9a", "40b2bcc31f374a5f"]
    assert crc24(bytes.fromhex("4009deadbeef123402 0106".replace(" ", ""))) == 0xAF1CB9
    assert [channel_mhz(c) for c in (0, 10, 11, 36, 37, 38, 39)] == [2404, 2424, 2428, 2478, 2402, 2426, 2480]


def test_kernels_against_plain_ones():
    random = np.random.default_rng(0)
    x, h = random.normal(size=300) + 1j * random.normal(size=300), random.normal(size=31)
    assert np.allclose(S.convolved(x, h), np.convolve(x, h)) and np.allclose(S.filtered(x, h), np.convolve(x, h, "same"), atol=1e-5)
    assert np.allclose(S.moving_sum(np.arange(10.0), 4), [6, 10, 14, 18, 22, 26, 30, 30, 30, 30])
    taps = S.low_pass(8e6, 1.1e6)
    assert taps.sum() == pytest.approx(1) and abs(np.fft.fft(taps, 4096)[int(4096 * 3 / 8)]) < 0.01
    f, p = S.welch(np.sin(2 * np.pi * 1e6 * np.arange(8192) / 8e6), 8e6, 512)
    assert abs(f[p.argmax()] - 1e6) < 8e6 / 512 and np.trapezoid(p, f) == pytest.approx(0.5, rel=0.05)
    raw = S.raw_samples(np.array([0.5 + 0.25j, -0.5j]), np.array([0.1, 0.2j]))
    assert np.allclose(S.samples(raw, 2, 1), [0.1, 0.2j], atol=1e-3)


def test_gates_and_peaks():
    assert spans(np.array([0, 1, 1, 0, 0, 0, 1, 0], bool), 1, 1) == [(0, 4), (5, 8)] and spans(np.ones(4, bool), 2, 2) == [(0, 4)]
    assert peaks(np.array([0, 0.7, 0.9, 0, 0, 0, 0, 0.8, 0.7]), 0.6, 2) == [2, 7] and peaks(np.zeros(5), 0.6, 2) == []
    assert settled(np.array([1, 1, 1, 0, 0, 0, 1])).tolist() == [False, True, False, False, True, False, False]


@pytest.mark.parametrize("cfo", [-30e3, 0.0, 45e3])
def test_offset_is_recovered(cfo):
    m = measured(Transmitter(cfo_hz=cfo))
    assert m["cfo_hz"][0] == pytest.approx(cfo, abs=4e3) and m["cfo_ppm"][0] == pytest.approx(cfo / 2440, abs=2)


@pytest.mark.parametrize("h", [0.46, 0.5, 0.54])
def test_modulation_index_is_recovered(h):
    assert measured(Transmitter(modulation_index=h))["modulation_index"][0] == pytest.approx(h, abs=0.02)


def test_drift_clock_and_shape_are_recovered():
    assert measured(Transmitter(drift_hz=20e3))["drift_hz"][0] == pytest.approx(20e3, abs=6e3)
    assert measured(Transmitter(clock_ppm=60, snr_db=50))["symbol_clock_ppm"][0] == pytest.approx(60, abs=10)
    assert measured(Transmitter(bt=0.4))["effective_bt"][0] < measured(Transmitter(bt=0.7))["effective_bt"][0]
    assert measured(Transmitter(ramp_us=6))["rise_time_us"][0] > measured(Transmitter(ramp_us=2))["rise_time_us"][0]


def test_power_and_paths():
    m = measured(Transmitter(amplitude=0.25, snr_db=25))
    assert m["rssi_dbfs"][0] == pytest.approx(20 * np.log10(0.25), abs=0.5) and m["snr_db"][0] == pytest.approx(25, abs=1.5)
    assert np.isnan(m["rssi_dbm"][0]) and measured(Transmitter(), rssi_cal_db=10.0, gain_db=20.0)["rssi_dbm"][0] == pytest.approx(m["rssi_dbfs"][0] - 10, abs=0.5)
    assert measured(Transmitter(echo=0.6, echo_us=1.0))["delay_spread_us"][0] > measured(Transmitter())["delay_spread_us"][0]
    assert set(C.MEASUREMENTS) - set(m) == {"antenna_phase_deg", "aoa_deg"} and "lo_leakage_dbc" not in measured(Transmitter(), full=False)


def test_antennas():
    x, start = burst(PACKET, Transmitter(), seed=1)
    f = packets(x, Receiver(), gate=False)[0]
    part = x[f.start : f.end]
    m = Burst(part, 8e6, f.sync - f.start, f.offset, f.bits, f.levels, second=part * np.exp(-1j * np.radians(60))).all()[0]
    assert m["antenna_phase_deg"][0] == pytest.approx(60, abs=0.1) and m["aoa_deg"][0] == pytest.approx(np.degrees(np.arcsin(60 / 180)), abs=0.1)


def test_wrong_channel_decodes_nothing_right():
    x, _ = burst(PACKET, Transmitter())
    found = packets(x, Receiver(channel=38), gate=False)
    assert all(crc24(f.data[:-3]) != int.from_bytes(f.data[-3:], "little") for f in found)


@pytest.fixture(scope="module")
def capture(spark):
    ts = [(advertisement(bytes([k % 3, 2, 3, 4, 5, 0xC6]), bytes([2, 1, 6, 3, 9, 65 + k % 3, 66])), Transmitter(cfo_hz=1e4 * (k % 3), snr_db=28)) for k in range(24)]
    x, starts = stream(ts, seed=5)
    return blocks(spark, x, size=4096).cache(), starts, ts


def test_each_packet_once_whatever_the_blocks(spark, capture):
    made, starts, ts = capture
    found = {r.abs_sync: bytes(r.pdu) for r in demodulate(made, Receiver(), 4096).collect()}
    assert len(found) == len(starts)
    for (at, data), start, (packet, _) in zip(sorted(found.items()), starts, ts, strict=True):
        assert abs(at - start) <= 4 and data == packet


def test_rows_of_packets(spark, capture):
    rows = numbered(packet_rows(capture[0], block_samples=4096)).orderBy("number").collect()
    assert [r.number for r in rows] == list(range(1, 25)) and all(r.crc_ok and r.pdu_name == "ADV_IND" for r in rows)
    assert [r.adva for r in rows[:3]] == ["C6:05:04:03:02:00", "C6:05:04:03:02:01", "C6:05:04:03:02:02"] and rows[1].info == "BB" and rows[0].adva_kind == "random static"
    assert all(r.cfo_hz == pytest.approx(1e4 * (k % 3), abs=9e3) for k, r in enumerate(rows))


def test_stream_equals_batch(spark, capture, tmp_path):
    from wavelake.streaming.queries import block_stream, collected, demodulated

    for k in range(4):
        capture[0].where(f"block_index % 4 >= 0 and block_index between {k * 8} and {k * 8 + 7}").coalesce(1).write.mode("append").parquet(str(tmp_path / "b"))
    got = collected(demodulated(block_stream(spark, str(tmp_path / "b"), 1), Receiver()), "found").select("abs_sync", "pdu").collect()
    want = demodulate(capture[0].where("block_index < 32"), Receiver(), 4096).select("abs_sync", "pdu").collect()
    assert sorted((r.abs_sync, bytes(r.pdu)) for r in got) == sorted((r.abs_sync, bytes(r.pdu)) for r in want) and len(got) > 3


def test_interference_figures():
    random = np.random.default_rng(0)
    n, fs = 16384, 8e6
    noise = (random.normal(size=n) + 1j * random.normal(size=n)) * 1e-3 / np.sqrt(2)
    tone = noise + 0.2 * np.exp(2j * np.pi * 3e5 * np.arange(n) / fs)
    idle, cw = B.interference(noise, fs, -60.0), B.interference(tone, fs, -60.0)
    assert idle["duty_cycle"] < 0.02 and cw["duty_cycle"] > 0.99 and cw["occupied_bandwidth_hz"] < 50e3 and B.interference(noise[:100], fs) == {}
    on = np.arange(8000) % 800 < 5
    assert B.period_ms(on, 8e5) == pytest.approx(1.0, rel=0.02) and np.isnan(B.period_ms(np.ones(1000, bool), fs))


def test_receiver_balance_is_recovered():
    random = np.random.default_rng(1)
    i, q = random.normal(size=(2, 200_000)) * 0.05
    x = (i * 1.08 + 0.01) + 1j * (q * np.cos(0.05) + i * np.sin(0.05) - 0.02)
    m = B.receiver_measure(x, 8e6)
    assert (m["dc_i"], m["dc_q"]) == (pytest.approx(0.01, abs=1e-3), pytest.approx(-0.02, abs=1e-3)) and m["gain_imbalance"] == pytest.approx(1.08, abs=0.01) and m["quadrature_skew_deg"] == pytest.approx(np.degrees(0.05), abs=0.3)
    fixed = B.balance(B.corrected(x, B.balance(x)))
    assert fixed["gain"] == pytest.approx(1, abs=1e-3) and abs(fixed["skew"]) < 1e-3 and B.receiver_measure(x[:100], 8e6) == {}


def test_block_figures_and_spectra(spark, capture):
    from wavelake.operators.analysis import classified
    from wavelake.plans.charts import spectrum, waterfall

    d = classified(B.block_figures(capture[0], 8e6), ["session", "epoch"]).collect()
    assert len(d) == capture[0].count() and all(r.classification for r in d)
    s = spectrum(capture[0].where("block_index < 3"), 8e6)
    assert s.count() == 3 * 1024 and s.where("peak_hold_dbfs < power_dbfs - 1e-9").count() == 0
    assert waterfall(capture[0].where("block_index < 3"), 8e6).where("level < 0 or level > 1").count() == 0


def test_sample_ranges(spark, capture):
    from wavelake.sources.files import sample_range

    got = sample_range(capture[0], 4000, 5000).first()
    whole = b"".join(bytes(r.iq) for r in capture[0].orderBy("block_index").collect())
    assert bytes(got.iq) == whole[16_000:36_000] and sample_range(capture[0], 10**9, 10).count() == 0
