"""Measurements of one packet's samples.

A Burst holds what several measurements share (frequency track, offset, deviation, transitions) and
computes it once. Each measurement is (value, uncertainty); what cannot be measured is nan inside and
null in tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .signal import filtered, frequency, line, low_pass, power_below, smooth, spectrum, welch

NAN = float("nan")
NONE = (NAN, NAN)
#: Units of the measurements.
UNITS = {
    **{k: "Hz" for k in ("cfo_hz", "cfo_preamble_hz", "cfo_payload_hz", "drift_hz", "dev_one_hz", "dev_zero_hz", "freq_error_rms", "freq_error_peak")},
    **{k: "dBc/Hz" for k in ("phase_noise_10kHz", "phase_noise_50kHz", "phase_noise_100kHz", "phase_noise_500kHz")},
    **{k: "us" for k in ("rise_time_us", "fall_time_us", "delay_spread_us")},
    **{k: "deg" for k in ("antenna_phase_deg", "aoa_deg")},
    "cfo_ppm": "ppm", "symbol_clock_ppm": "ppm", "symbol_jitter_ps": "ps", "drift_rate": "Hz/50us", "lo_leakage_dbc": "dBc", "image_rejection_db": "dB", "splatter_db": "dB", "snr_db": "dB", "rssi_dbfs": "dBFS", "rssi_dbm": "dBm",
}


def _mean(x: np.ndarray) -> tuple[float, float]:
    n = len(x)
    if not n:
        return NAN, NAN
    # As mean() and std() of numpy have it, which for some hundred values are mostly their own calls.
    mean = np.add.reduce(x) / n
    d = x - mean
    return float(mean), float(np.sqrt(np.add.reduce(d * d) / n) / np.sqrt(n)) if n > 1 else NAN


def _median(x: np.ndarray) -> float:
    n = len(x)
    p = np.partition(x, ((n - 1) // 2, n // 2))
    return float((p[(n - 1) // 2] + p[n // 2]) / 2)


def settled(bits: np.ndarray) -> np.ndarray:
    """Which bits stand between two of their own kind."""
    out = np.zeros(len(bits), bool)
    out[1:-1] = (bits[1:-1] == bits[:-2]) & (bits[1:-1] == bits[2:])
    return out


def _rise_through(rows: np.ndarray) -> np.ndarray:
    """Place, between samples, at which each row first comes up through zero; nan where none does."""
    up = (rows[:, :-1] < 0) & (rows[:, 1:] >= 0)
    k = up.argmax(1)
    i = np.arange(len(rows))
    with np.errstate(all="ignore"):
        place = k - rows[i, k] / (rows[i, k + 1] - rows[i, k])
    return np.where(up.any(1), place, NAN)


class Transitions(NamedTuple):
    """Of each change of bit: whether rising and isolated, expected and found crossing, duration in seconds."""

    rising: np.ndarray
    isolated: np.ndarray
    expected: np.ndarray
    crossing: np.ndarray
    duration: np.ndarray


class Burst:
    def __init__(self, x, sample_rate: float, sync: int, offset: float, bits, levels, gain_db: float = 0.0, carrier_hz: float = C.CARRIER_HZ, rssi_cal_db: float | None = None, second=None, antenna_cal_rad: float = 0.0, full: bool = True):
        self.x, self.rate, self.sps, self.sync, self.offset = np.asarray(x), sample_rate, sample_rate / C.SYMBOL_RATE, int(sync), offset
        self.n = min(len(bits), len(levels))
        self.bits, self._levels = np.asarray(bits)[: self.n].astype(int), np.asarray(levels, float)[: self.n]
        self.gain_db, self.carrier_hz, self.rssi_cal_db, self.second, self.antenna_cal, self.full = gain_db, carrier_hz, rssi_cal_db, second, antenna_cal_rad, full
        self.end = int(min(sync + offset + self.n * self.sps, len(self.x)))

    # -- frequency ---------------------------------------------------------------------------

    @cached_property
    def track(self) -> np.ndarray:
        """Instantaneous frequency through the wide measurement filter."""
        return frequency(filtered(self.x, low_pass(self.rate, C.MEASUREMENT_FILTER_HZ, C.FILTER_TAPS)), self.rate)

    @cached_property
    def level(self) -> np.ndarray:
        """Frequency at each symbol."""
        at = np.rint(self.sync + self.offset + np.arange(self.n) * self.sps).astype(int)
        inside = len(self.track) and (not len(at) or at.min() >= 0 and at.max() < len(self.track))
        return self.track[at] if inside else self._levels

    def _offset(self, deviation: float, part=slice(None), least: int = 8) -> tuple[float, float]:
        r = self.level[part] - (2 * self.bits[part] - 1) * deviation
        return _mean(r) if len(r) >= least else NONE

    def _sides(self, cfo: float) -> tuple[tuple[float, float], tuple[float, float]]:
        """Mean settled deviation of ones and zeros."""
        s = settled(self.bits)
        one, zero = self.level[s & (self.bits == 1)] - cfo, cfo - self.level[s & (self.bits == 0)]
        return (_mean(one), _mean(zero)) if self.n >= 16 and min(len(one), len(zero)) >= 3 else (NONE, NONE)

    @cached_property
    def sides(self):
        rough = float(np.clip(np.abs(self.level - _median(self.level)).mean(), 100e3, 400e3)) if self.n else C.NOMINAL_DEVIATION
        first = self._offset(rough)[0]
        return (*self._sides(first), rough)

    @cached_property
    def deviation(self) -> float:
        one, zero, rough = self.sides
        mean = (one[0] + zero[0]) / 2
        return mean if np.isfinite(mean) and mean > 0 else rough

    @cached_property
    def cfo(self) -> tuple[float, float]:
        return self._offset(self.deviation)

    def offsets(self) -> dict:
        scale = 1e6 / self.carrier_hz
        late = self._offset(self.deviation, slice(40, None)) if self.n > 48 else NONE
        return {"cfo_hz": self.cfo, "cfo_ppm": (self.cfo[0] * scale, self.cfo[1] * scale), "cfo_preamble_hz": self._offset(self.deviation, slice(0, 8), 4), "cfo_payload_hz": late}

    def drift(self) -> dict:
        if self.n < 32:
            return {"drift_hz": NONE, "drift_rate": NONE}
        r = self.level - (2 * self.bits - 1) * self.deviation
        curve = smooth(r, 2)
        spread = float((r - curve).std()) * np.sqrt(2)
        steps = curve[50:] - curve[:-50]
        worst = float(steps[np.abs(steps).argmax()]) if self.n > 50 else NAN
        return {"drift_hz": (float(curve[-1] - curve[0]), spread), "drift_rate": (worst, spread)}

    def modulation(self) -> dict:
        one, zero, _ = self.sides
        mean, spread = (one[0] + zero[0]) / 2, np.hypot(one[1], zero[1])
        asymmetry = ((one[0] - zero[0]) / mean, spread / mean) if mean > 0 else NONE
        index = (2 * mean / C.SYMBOL_RATE, spread / C.SYMBOL_RATE) if np.isfinite(mean) else NONE
        return {"dev_one_hz": one, "dev_zero_hz": zero, "dev_asymmetry": asymmetry, "modulation_index": index}

    def errors(self) -> dict:
        out = {"freq_error_rms": NONE, "freq_error_peak": NONE, "eye_opening": NONE, "residual_isi": NONE}
        s = settled(self.bits)
        if self.n >= 8:
            e = self.level - self.cfo[0] - (2 * self.bits - 1) * self.deviation
            e = e[s] if s.sum() >= 8 else e
            rms = float(np.sqrt((e**2).mean()))
            out |= {"freq_error_rms": (rms, rms / np.sqrt(2 * len(e))), "freq_error_peak": (float(np.abs(e).max()), NAN)}
        f = (self.level - self.cfo[0]) / self.deviation
        ones, zeros = f[self.bits == 1], f[self.bits == 0]
        if self.n >= 16 and min(len(ones), len(zeros)) >= 4:
            out["eye_opening"] = (float(ones.min() - zeros.max()), NAN)
            one, zero = f[s & (self.bits == 1)], f[s & (self.bits == 0)]
            if s.sum() >= 8 and len(one) and len(zero):
                out["residual_isi"] = (float(np.sqrt(((f - np.where(self.bits == 1, one.mean(), zero.mean())) ** 2).mean())), NAN)
        return out

    # -- transitions -------------------------------------------------------------------------

    @cached_property
    def transitions(self) -> Transitions:
        """Changes of bit away from the ends."""
        b, n = self.bits, self.n
        k = np.flatnonzero(np.diff(b)) + 1 if n >= 8 else np.zeros(0, int)
        k = k[(k >= 2) & (k < n - 2)]
        expected = self.sync + self.offset + (k - 0.5) * self.sps
        first = np.floor(expected - self.sps).astype(int)
        width = int(np.ceil(2 * self.sps)) + 2
        inside = (first >= 0) & (first + width <= len(self.track))
        k, expected, first = k[inside], expected[inside], first[inside]
        if not len(k):
            return Transitions(*[np.zeros(0, bool)] * 2, *[np.zeros(0)] * 3)
        rising = b[k] == 1
        sign = np.where(rising, 1.0, -1.0)[:, None]
        wave = self.track[first[:, None] + np.arange(width)] * sign
        low, high = wave.min(1, keepdims=True), wave.max(1, keepdims=True)
        crossing = first + _rise_through(wave - self.cfo[0] * sign)
        length = _rise_through(wave - low - 0.9 * (high - low)) - _rise_through(wave - low - 0.1 * (high - low))
        length = np.where((high - low)[:, 0] >= 50e3, np.abs(length) / self.rate, NAN)
        return Transitions(rising, (b[k - 1] == b[k - 2]) & (b[k] == b[k + 1]), expected, crossing, length)

    def shape(self) -> dict:
        t = self.transitions
        out = {"effective_bt": NONE, "transition_asymmetry": NONE, "symbol_clock_ppm": NONE, "symbol_jitter_ps": NONE}
        clean = t.isolated & (t.duration > 0)
        d = t.duration[clean]
        if len(d):
            scale = C.BT_SLOPE / max(d.mean() * C.SYMBOL_RATE, 1e-9)
            spread = d.std() / max(d.mean(), 1e-12) / np.sqrt(len(d)) if len(d) > 1 else NAN
            out["effective_bt"] = (float(np.clip(scale + C.BT_INTERCEPT, 0.05, 5)), float(scale * spread))
        up, down = t.duration[clean & t.rising], t.duration[clean & ~t.rising]
        if min(len(up), len(down)) >= 2:
            (a, ua), (z, uz) = _mean(up), _mean(down)
            out["transition_asymmetry"] = ((a - z) / (a + z), float(np.hypot(ua, uz) / (a + z)))
        seen = np.isfinite(t.crossing)
        if seen.sum() >= 12:
            e = t.expected[seen]
            late = t.crossing[seen] - e
            slope, base = line(e, late)
            rest = float((late - slope * e - base).std())
            out["symbol_clock_ppm"] = (float(-slope * 1e6), rest / max(e.std() * np.sqrt(len(e)), 1e-9) * 1e6)
            out["symbol_jitter_ps"] = (rest / self.rate * 1e12, NAN)
        return out

    # -- spectrum ----------------------------------------------------------------------------

    @property
    def body(self) -> np.ndarray:
        return self.x[self.sync : self.end]

    def spectral(self) -> dict:
        out = {f"phase_noise_{k}kHz": NONE for k in (10, 50, 100, 500)} | {"lo_leakage_dbc": NONE, "image_rejection_db": NONE}
        x = self.body
        if len(x) >= 512:
            phase = np.unwrap(np.angle(x.astype(np.complex128)))
            f, density = welch(phase - smooth(phase, 3), self.rate, 512)
            spread = 4.34 / np.sqrt(max(len(x) // 256 - 1, 1))
            for k in (10, 50, 100, 500):
                if k * 1e3 < self.rate / 2:
                    out[f"phase_noise_{k}kHz"] = (float(10 * np.log10(max(density[np.abs(f - k * 1e3).argmin()], 1e-20))), spread)
        if len(x) >= 256:
            n = power_below(len(x))
            f, p = spectrum(x[:n], self.rate)
            if p.sum() > 0:
                near = lambda centre, half: float(p[np.abs(f - centre) < half].sum())
                out["lo_leakage_dbc"] = (10 * np.log10(max(near(0, max(3 * self.rate / n, 20e3)) / p.sum(), 1e-15)), 1.0)
                out["image_rejection_db"] = (10 * np.log10(max(near(self.cfo[0], 400e3), 1e-20) / max(near(-self.cfo[0], 400e3), 1e-20)), 1.0)
        return out

    def splatter(self) -> dict:
        n = int(10e-6 * self.rate)
        a = max(self.sync - n // 2, 0)
        x = self.x[a : a + n]
        if len(x) < 64:
            return {"splatter_db": NONE}
        f, p = spectrum(x[: power_below(len(x))], self.rate)
        inner = float(p[np.abs(f) <= 500e3].sum())
        return {"splatter_db": (10 * np.log10(max(float(p[np.abs(f) > 1e6].sum()), 1e-20) / inner), 1.0) if inner > 0 else NONE}

    # -- envelope and power ------------------------------------------------------------------

    def envelope(self) -> tuple[dict, np.ndarray]:
        out, ramp = {"rise_time_us": NONE, "overshoot": NONE, "fall_time_us": NONE}, np.zeros(32, np.float32)
        if len(self.x) < 64:
            return out, ramp
        k = max(int(self.rate / 4e6), 1)
        env = np.convolve(np.abs(self.x).astype(float), np.ones(k) / k, "same")
        a = int(np.clip(self.sync, 0, len(env) - 2))
        z = max(min(self.end, len(env)), a + 2)
        steady, floor = _median(env[a:z]), _median(env[: max(a // 2, 1)]) if a > 8 else 0.0
        span = steady - floor
        if span <= 0:
            return out, ramp
        us = 1e6 / self.rate
        low, high = floor + 0.1 * span, floor + 0.9 * span
        on = env[max(a - int(20e-6 * self.rate), 0) : a + max(int(10e-6 * self.rate), 4)]
        top, bottom = np.flatnonzero(on >= high), np.flatnonzero(on <= low)
        if len(on) > 4 and len(top) and len(bottom) and bottom[0] < top[0]:
            out["rise_time_us"] = (float(top[0] - bottom[bottom < top[0]][-1]) * us, us)
            after = on[top[0] : top[0] + int(5e-6 * self.rate)]
            if len(after) > 2:
                out["overshoot"] = ((float(after.max()) - steady) / span, NAN)
        off = env[z - 2 :]
        top, bottom = np.flatnonzero(off >= high), np.flatnonzero(off <= low)
        if len(off) > 4 and len(top) and len(bottom[bottom > top[0]]):
            out["fall_time_us"] = (float(bottom[bottom > top[0]][0] - top[0]) * us, us)
        piece = env[max(a - int(10e-6 * self.rate), 0) : a + int(10e-6 * self.rate)]
        if len(piece) > 4 and np.ptp(piece) > 0:
            v = np.interp(np.linspace(0, 1, 32), np.linspace(0, 1, len(piece)), piece)
            ramp = ((v - v.min()) / np.ptp(v)).astype(np.float32) if np.ptp(v) > 0 else ramp
        return out, ramp

    def power(self) -> dict:
        a = int(np.clip(self.sync, 0, max(len(self.x) - 2, 0)))
        p = np.abs(self.x.astype(np.complex128)) ** 2
        signal = float(p[a : max(self.end, a + 2)].mean()) if len(p) else 0.0
        dbfs = 10 * np.log10(signal) if signal > 0 else NAN
        noise = float(p[: a - 8].mean()) if a >= 32 else NAN
        return {
            "rssi_dbfs": (dbfs, 0.5),
            "rssi_dbm": (dbfs - self.gain_db + self.rssi_cal_db, 2.0) if self.rssi_cal_db is not None else NONE,
            "snr_db": (10 * np.log10((signal - noise) / noise), 1.0) if noise > 0 and signal > noise else NONE,
        }

    # -- paths and antennas ------------------------------------------------------------------

    def ideal(self, bt: float = 0.5) -> np.ndarray:
        """The packet as its bits would sound: Gaussian-shaped frequency at the measured offset and deviation."""
        impulses = np.zeros(int(np.ceil(self.n * self.sps)) + 8)
        np.add.at(impulses, np.minimum(np.rint(np.arange(self.n) * self.sps).astype(int), len(impulses) - 1), 2.0 * self.bits - 1)
        width = round(4 * self.sps) | 1
        t = (np.arange(width) - width // 2) / self.sps
        h = np.exp(-2 * (np.pi * bt * t) ** 2 / np.log(2))
        wave = np.convolve(impulses, h / h.sum() * self.sps, "same") * self.deviation + self.cfo[0]
        return np.exp(2j * np.pi * np.cumsum(wave) / self.rate)

    def paths(self) -> tuple[dict, np.ndarray]:
        """RMS spread of delays, and power by delay of the first 3 us."""
        none = {"delay_spread_us": NONE}, np.zeros(0, np.float32)
        if not self.full or not np.isfinite(self.cfo[0]):
            return none
        y = self.ideal()
        n = min(len(self.body), len(y))
        if n < 128:
            return none
        a = self.body[:n].astype(np.complex128)
        # Only the first delays are looked at: so many products of the two, and no whole correlation.
        p = np.abs(np.correlate(np.pad(a - a.mean(), (0, max(int(3e-6 * self.rate), 4) - 1)), y[:n])) ** 2
        if p.max() <= 0:
            return none
        p = p / p.max()
        lag = np.arange(len(p)) / self.rate * 1e6
        w = np.where(p > 0.01, p, 0)
        middle = (w * lag).sum() / w.sum()
        return {"delay_spread_us": (float(np.sqrt((w * (lag - middle) ** 2).sum() / w.sum())), NAN)}, p.astype(np.float32)

    def antennas(self, spacing: float = 0.5) -> dict:
        if self.second is None or not len(self.second):
            return {}
        n = min(len(self.x), len(self.second), self.end) - self.sync
        if n < 32:
            return {"antenna_phase_deg": NONE, "aoa_deg": NONE}
        part = slice(self.sync, self.sync + n)
        turn = float(np.angle((self.x[part].astype(np.complex128) * np.conj(self.second[part])).mean())) - self.antenna_cal
        turn = (turn + np.pi) % (2 * np.pi) - np.pi
        arg = turn / (2 * np.pi * spacing)
        return {"antenna_phase_deg": (np.degrees(turn), NAN), "aoa_deg": (float(np.degrees(np.arcsin(arg))), NAN) if abs(arg) <= 1 else NONE}

    def all(self) -> tuple[dict, np.ndarray, np.ndarray]:
        """All measurements by name, the ramp, and the delay profile."""
        edges, ramp = self.envelope()
        spread, profile = self.paths()
        found = self.offsets() | self.drift() | self.modulation() | self.errors() | self.shape() | (self.spectral() if self.full else {}) | edges | self.splatter() | self.power() | spread | self.antennas()
        return found, ramp, profile


MEASURED = "session string, epoch int, abs_sync long, " + ", ".join(f"{k} double, {k}_unc double" for k in C.MEASUREMENTS) + ", ramp array<float>, profile array<float>, features_full boolean"


#: What measurements are taken from.
READ = ("session", "epoch", "abs_sync", "abs_slice_start", "sym_offset", "slice", "slice_2", "bits", "levels", "gain_db", "frequency_hz")


def measure(detections: DataFrame, sample_rate: float = 8e6, rssi_cal_db: float | None = None, antenna_cal_rad: float = 0.0, full: bool | str = True, kept: Sequence[str] = ()) -> DataFrame:
    """DETECTIONS -> one row of measurements each, nan as null, and after these the columns in `kept`. Only the columns it reads are shipped.

    full: whether the costly figures are taken too, or the column that tells so of each row.
    """
    each, whole = ([F.col(full).alias("full_features")], None) if isinstance(full, str) else ([], full)
    types = {f.name: f.dataType.simpleString() for f in detections.schema}
    d = detections.select(*READ, *[k for k in kept if k not in READ], *each)
    return d.mapInPandas(lambda batches: measured(batches, sample_rate, rssi_cal_db, antenna_cal_rad, whole, kept), ", ".join([MEASURED, *[f"{k} {types[k]}" for k in kept]]))


def measured(batches: Iterator[pd.DataFrame], sample_rate: float = 8e6, rssi_cal_db: float | None = None, antenna_cal_rad: float = 0.0, full: bool | None = True, kept: Sequence[str] = ()) -> Iterator[pd.DataFrame]:
    """Frames of DETECTIONS -> frames of MEASURED and the columns in `kept`; full None: full_features tells it of each row."""
    names = [c.split()[0] for c in MEASURED.split(", ")]
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            second = np.frombuffer(r.slice_2, np.complex64) if r.slice_2 is not None else None
            whole = bool(r.full_features) if full is None else full
            burst = Burst(np.frombuffer(r.slice, np.complex64), sample_rate, r.abs_sync - r.abs_slice_start, r.sym_offset, np.frombuffer(r.bits, np.uint8), r.levels, r.gain_db or 0, r.frequency_hz or C.CARRIER_HZ, rssi_cal_db, second, antenna_cal_rad, whole)
            m, ramp, profile = burst.all()
            flat = [None if not np.isfinite(v) else float(v) for k in C.MEASUREMENTS for v in m.get(k, NONE)]
            out.append((r.session, r.epoch, r.abs_sync, *flat, ramp, profile, whole))
        yield pd.concat([pd.DataFrame(out, columns=names), b[list(kept)].reset_index(drop=True)], axis=1) if kept else pd.DataFrame(out, columns=names)


def measurement(key: str, calibrated=None):
    """A measurement's struct (value, uncertainty, units, calibrated, spec_low, spec_high) from its two columns."""
    low, high = C.LIMITS.get(key, C.LIMITS["deviation"] if key in ("dev_one_hz", "dev_zero_hz") else C.LIMITS["cfo_hz"] if key.startswith("cfo_") and key.endswith("_hz") else (None, None))
    return F.struct(
        F.col(key).alias("value"), F.col(f"{key}_unc").alias("uncertainty"), F.lit(UNITS.get(key, "")).alias("units"), (F.lit(True) if calibrated is None else calibrated).alias("calibrated"),
        F.lit(low).cast("double").alias("spec_low"), F.lit(high).cast("double").alias("spec_high"),
    ).alias(f"m_{key}")
