"""All of a session's analysis as one stream: whitening, clusters, splits, bursts, baselines, alerts.

Three stateful operators in a row, each with typed state in RocksDB:

1. by session: running moments of the vector, which whiten each packet as it comes;
2. by session and address: clusters, delay profile, last values, last times and the enrolled baseline;
3. by session: labels of clusters as they appear.

Rows equal those of plans.capture.analyze() over the same packets, if these arrive in order of number
within a session: files of a trigger in any order, triggers one after the other. Packets that analysis
does not read (events, wrong checks, no address) go past the operators.

Control rows reset a session: an event row of kind "reset" clears its moments, its devices and its labels
before the packets of greater number. It goes to each address that has come so far in the session.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..operators.analysis import Device, processed
from ..operators.stats import good
from ..plans.capture import BIMODAL, enrolled, observed, with_alerts

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Kind of the event row that resets a session.
RESET = "reset"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which these operators need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class Moments:
    """Numbers, sums and squares of columns, about their first mean: running means and sample deviations."""

    def __init__(self, width: int, n=None, a=None, q=None, c=None):
        self.n, self.a, self.q = (np.zeros(width) if x is None else np.array(x, float) for x in (n, a, q))
        self.c = np.full(width, np.nan) if c is None else np.array([np.nan if v is None else v for v in c], float)

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, mean, std) up to and with each row of x; std is not a number below two values."""
        seen = np.isfinite(x)
        new = np.isnan(self.c) & seen.any(0)
        with np.errstate(invalid="ignore", divide="ignore"):
            self.c = np.where(new, np.where(seen, x, 0).sum(0) / seen.sum(0), self.c)
        y = np.where(seen, x - np.nan_to_num(self.c), 0.0)
        n, a, q = self.n + np.cumsum(seen, 0), self.a + np.cumsum(y, 0), self.q + np.cumsum(y * y, 0)
        if len(x):
            self.n, self.a, self.q = n[-1], a[-1], q[-1]
        some = np.maximum(n, 1)
        std = np.sqrt(np.maximum((q - a * a / some) / np.maximum(n - 1, 1), 0))
        return n, np.where(n > 0, self.c + a / some, np.nan), np.where(n > 1, std, np.nan)

    def state(self) -> tuple:
        return self.n.tolist(), self.a.tolist(), self.q.tolist(), [None if np.isnan(v) else v for v in self.c.tolist()]


_MOMENTS = "n array<double>, a array<double>, q array<double>, c array<double>"


#: What the second operator adds to a packet.
_FOUND = "cluster int, separation double, cluster_alert string, bimodal_alert string, multipath_alert string, recent int, anomaly_score double, anomaly_contributions map<string,double>, valid boolean"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a trigger, resets before the packets of their number."""
    return pd.concat(list(batches)).sort_values(["number", "reset_"], ascending=[True, False], kind="stable").reset_index(drop=True)


def _stretches(rows: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame]]:
    """(the reset that comes first, or no row; packets) between resets."""
    reset = rows["reset_"].to_numpy(bool)
    for _, part in rows.groupby(np.cumsum(reset), sort=True):
        own = part["reset_"].to_numpy(bool)
        yield part[own], part[~own]


class _Processor(StatefulProcessor):
    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def close(self) -> None:
        pass


class Whitener(_Processor):
    """By session: packets with their whitened vector; a reset is passed on to each address of the session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", _MOMENTS, self.ttl)
        self.addresses = handle.getMapState("addresses", "adva string", "seen boolean", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _in_order(rows)
        moments = Moments(len(C.VECTOR), *self.moments.get()) if self.moments.exists() else Moments(len(C.VECTOR))
        known = {k[0] for k in self.addresses.keys()}
        for reset, part in _stretches(rows):
            if len(reset):
                moments = Moments(len(C.VECTOR))
                if known:
                    yield pd.concat([reset.assign(adva=a, white=None) for a in sorted(known)])
            if len(part):
                x = np.array([[np.nan if v is None else v for v in r] for r in part["vector"]], float)
                _, mean, std = moments.add(x)
                white = np.nan_to_num((x - mean) / np.where(np.nan_to_num(std) > 1e-12, std, 1.0), nan=0.0, posinf=0.0, neginf=0.0)
                for a in set(part["adva"]) - known:
                    self.addresses.updateValue((a,), (True,))
                    known.add(a)
                yield part.assign(white=list(white))
        self.moments.update(moments.state())


class Devices(_Processor):
    """By session and address: packets with clusters, what tests of the address's order find, and scores."""

    def __init__(self, needed: tuple[int, int, int], ttl_ms: int | None):
        super().__init__(ttl_ms)
        self.needed = needed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "k int", "centre array<double>, n long, radius2 double", self.ttl)
        self.course = handle.getValueState("course", "packets long, profile array<double>, distances array<double>, times array<double>", self.ttl)
        self.values = handle.getMapState("values", "k int", "key string, last array<double>", self.ttl)
        self.baseline = handle.getValueState("baseline", f"packets long, {_MOMENTS}, degrees array<double>, bands array<double>", self.ttl)

    def _load(self) -> tuple[Device, list, list]:
        d, times = Device(), []
        for k in sorted(x[0] for x in self.clusters.keys()):
            centre, n, radius2 = self.clusters.getValue((k,))
            d.centres.append(np.array(centre, float))
            d.counts.append(n)
            d.radii2.append(radius2)
        if self.course.exists():
            packets, profile, distances, times = self.course.get()
            d.packets, d.distances = packets, list(distances)
            d.profile = np.array(profile, float) if profile is not None else None
        for k in sorted(x[0] for x in self.values.keys()):
            key, last = self.values.getValue((k,))
            d.values[key] = deque(last, maxlen=C.BIMODAL_HISTORY)
        return d, list(times), self._loaded_baseline()

    def _loaded_baseline(self) -> list:
        if not self.baseline.exists():
            return [0, Moments(len(C.VECTOR)), set(), set()]
        packets, n, a, q, c, degrees, bands = self.baseline.get()
        return [packets, Moments(len(C.VECTOR), n, a, q, c), set(degrees), set(bands)]

    def _keep(self, d: Device, times: list, base: list) -> None:
        for k, (centre, n, radius2) in enumerate(zip(d.centres, d.counts, d.radii2, strict=True)):
            self.clusters.updateValue((k,), (np.asarray(centre).tolist(), int(n), float(radius2)))
        for k, (key, last) in enumerate(d.values.items()):
            self.values.updateValue((k,), (key, [float(v) for v in last]))
        self.course.update((d.packets, d.profile.tolist() if d.profile is not None else None, [float(x) for x in d.distances], times))
        packets, moments, degrees, bands = base
        if packets:
            self.baseline.update((packets, *moments.state(), sorted(degrees), sorted(bands)))

    def _scored(self, part: pd.DataFrame, base: list) -> tuple[list, list, list]:
        """Scores, contributions and validity of an enrolled address's packets; the baseline goes along."""
        x = np.array([[np.nan if v is None else v for v in r] for r in part["vector"]], float)
        n, mean, std = base[1].add(x)
        count = base[0] + np.arange(1, len(x) + 1)
        base[0] += len(x)
        bound = np.array([k in C.CLOCK_BOUND for k in C.VECTOR])
        clock = part["calibrated_"].fillna(False).to_numpy(bool)
        with np.errstate(invalid="ignore", divide="ignore"):
            z = (x - mean) / std
            told = np.isfinite(z) & (n >= C.BASELINE_FEATURE_LEAST) & (std > 0) & (clock[:, None] | ~bound) & (count >= C.BASELINE_LEAST)[:, None]
        scores, parts, valid = [], [], []
        for i in range(len(x)):
            own = z[i, told[i]]
            scores.append(float(np.sqrt((own * own).mean())) if len(own) else None)
            parts.append({k: float(v) for k, v, t in zip(C.VECTOR, z[i], told[i], strict=True) if t} or None)
            for at, bucket in ((2, part["degree_"].iloc[i]), (3, part["band_"].iloc[i])):
                if bucket is not None and not np.isnan(bucket):
                    base[at].add(float(bucket))
            valid.append(bool(count[i] >= self.needed[0] and len(base[2]) >= self.needed[1] and len(base[3]) >= self.needed[2]))
        return scores, parts, valid

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _in_order(rows)
        device, times, base = self._load()
        for reset, part in _stretches(rows):
            if len(reset):
                self.clusters.clear()
                self.values.clear()
                self.baseline.clear()
                device, times, base = Device(), [], [0, Moments(len(C.VECTOR)), set(), set()]
                yield reset.assign(**dict.fromkeys(_FOUND_NAMES))
            if not len(part):
                continue
            found = processed(device, key[-1], part.assign(vector=part["white"]), BIMODAL)
            recent = []
            for t in part["timestamp_us"]:
                times = [*times, float(t)][-C.BURST_ROWS :]
                near = sum(t - x < C.BURST_US for x in times)
                recent.append(near if near > C.BURST_COUNT else None)
            mine = part["enrolled_"].to_numpy(bool)
            scores, parts, valid = self._scored(part, base) if mine.all() else ([None] * len(part),) * 3
            told = {"cluster": found["cluster"].to_numpy(), "separation": found["separation"].to_numpy(), **{c: found[c].to_numpy() for c in ("cluster_alert", "bimodal_alert", "multipath_alert")}}
            yield part.assign(**told, recent=pd.array(recent, "Int32"), anomaly_score=scores, anomaly_contributions=parts, valid=pd.array(valid, "boolean"))
        self._keep(device, times, base)


class Labels(_Processor):
    """By session: clusters of all addresses, numbered as they appear."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.labels = handle.getMapState("labels", "adva string, cluster int", "label long", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _in_order(rows)
        known = {tuple(k): v[0] for k, v in self.labels.iterator()}
        for reset, part in _stretches(rows):
            if len(reset):
                self.labels.clear()
                known = {}
            out = []
            for who in zip(part["adva"], part["cluster"].astype(int), strict=True):
                if who not in known:
                    known[who] = len(known)
                    self.labels.updateValue(who, (known[who],))
                out.append(known[who])
            if out:
                yield part.assign(cluster_id=out)


def _with(schema: T.StructType, more: str) -> T.StructType:
    return T.StructType([*schema.fields, *T._parse_datatype_string(more).fields])


def analysis(packets: DataFrame, enroll: tuple[str, ...] = (), threshold: float = C.ANOMALY_ALERT, needed: tuple[int, int, int] = (C.ENROLL_PACKETS, C.ENROLL_TEMPERATURES, C.ENROLL_DISTANCES), ttl_ms: int | None = None) -> DataFrame:
    """A stream of packet rows, with session and number -> the rows of plans.capture.analyze(). Start it inside rocksdb().

    ttl_ms: what is remembered of a key that is silent for so long is dropped.
    """
    have, none = set(packets.columns), F.lit(None).cast("double")
    finite = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c).cast("double")) if c in have else none
    plain = packets.drop("alerts", "anomaly_score", "anomaly_contributions")
    reset = F.coalesce(F.col("is_event") & (F.col("event_kind") == RESET), F.lit(False)) if "event_kind" in have else F.lit(False)
    mine = F.coalesce(enrolled(enroll), F.lit(False)) if enroll else F.lit(False)
    # Names don't begin with a bar: rows come to the processors as named tuples.
    told = {
        "reset_": reset, "enrolled_": mine, "calibrated_": F.coalesce(F.col("calibrated"), F.lit(False)) if "calibrated" in have else F.lit(False),
        "degree_": F.bround(finite("temperature_c"), 0), "band_": F.floor(finite("rssi_dbfs") / C.DISTANCE_DB).cast("double"),
        "vector": F.array(*[finite(k) for k in C.VECTOR]),
    }
    read = plain.where(good() | reset)
    mode = "ProcessingTime" if ttl_ms else "None"
    profile, values = observed(packets)
    names = [c for c in plain.columns if c != "profile"]
    rows = read.select(*names, profile, values, *[c.alias(k) for k, c in told.items()])
    white = _with(rows.schema, "white array<double>")
    rows = rows.groupBy("session").transformWithStateInPandas(Whitener(ttl_ms), white, "Append", mode)
    found = _with(white, _FOUND)
    rows = rows.groupBy("session", "adva").transformWithStateInPandas(Devices(needed, ttl_ms), found, "Append", mode)
    rows = rows.groupBy("session").transformWithStateInPandas(Labels(ttl_ms), _with(found, "cluster_id long"), "Append", mode)
    kept = plain.columns
    results = [f for f in _with(found, "cluster_id long").fields if f.name in (*_FOUND_NAMES[1:], "cluster_id")]
    rest = plain.where(~(good() | reset) | reset).select(*kept, *[F.lit(None).cast(f.dataType).alias(f.name) for f in results])
    return with_alerts(rows.select(*kept, *[f.name for f in results]).unionByName(rest), threshold)
