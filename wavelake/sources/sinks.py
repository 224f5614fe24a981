"""Sinks: tables, packet captures, sample captures, manifests, calibration history."""

from __future__ import annotations

import json
import math
import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .. import constants as C
from ..functions.scalars import as_row

PCAP_HEADER = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 512, 256)


def export_rows(packets: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """What an export holds: the packets shown, or all where a filter leaves none; no event rows."""
    d = packets if shown is None or shown.isEmpty() else shown
    return as_row(d.where(~F.col("is_event")))


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows as CSV with a header; arrays as text."""
    flat = rows.select(*[F.col(c).cast("string").alias(c) if t.startswith(("array", "map", "struct", "binary")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", "true").csv(path)


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def pcap_record(wall_time: float, channel: int, signal_dbm: float | None, noise_dbfs: float | None, access_address: int, raw: bytes, crc_ok: bool) -> bytes:
    """One packet of a capture file: time, lengths, radio header, address, packet.

    Fixed values of the header: whitening removed 0x1, strength valid 0x2, noise valid 0x4, reference
    address valid 0x10, check looked at 0x400, check right 0x800.
    """
    number = lambda v: v is not None and math.isfinite(v)
    level = lambda v: max(-128, min(127, round(v))) if number(v) else 0
    flags = 0x1 | 0x10 | 0x400 | (0x800 if crc_ok else 0) | (0x2 if number(signal_dbm) else 0) | (0x4 if number(noise_dbfs) else 0)
    body = struct.pack("<BbbBIH", channel, level(signal_dbm), level(noise_dbfs), 0, access_address, flags) + struct.pack("<I", access_address) + raw
    seconds = int(wall_time)
    return struct.pack("<IIII", seconds, int((wall_time - seconds) * 1e6), len(body), len(body)) + body


def pcap_records(packets: DataFrame) -> DataFrame:
    """(wall_time, number, record) of packets that have bytes, made in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [pcap_record(*r) for r in zip(b["wall_time"], b["channel"].astype(int), b["rssi_dbm"], b["noise_floor_dbfs"], b["access_address"].astype("int64"), b["raw_bytes"], b["crc_ok"].astype(bool), strict=True)]
            yield pd.DataFrame({"wall_time": b["wall_time"], "number": b["number"], "record": made})

    d = packets.where(~F.col("is_event") & (F.octet_length("raw_bytes") > 0))
    return d.select("wall_time", "number", "channel", "rssi_dbm", "noise_floor_dbfs", "access_address", "raw_bytes", "crc_ok").mapInPandas(run, "wall_time double, number long, record binary")


class _Part(WriterCommitMessage):
    def __init__(self, path: str, rows: int):
        self.path, self.rows = path, rows


class PcapSource(DataSource):
    """Writer `wavelake_pcap`: a capture file for each partition of pcap_records(), in order of its rows.

    Rows that are range-partitioned and sorted by time give files that follow one another. The path
    is a folder that driver and executors share. Tasks write to a folder of their job, and the driver
    moves whole files to the path once all tasks are done; a job that fails leaves nothing.
    """

    @classmethod
    def name(cls) -> str:
        return "wavelake_pcap"

    def writer(self, schema, overwrite: bool):
        return _PcapWriter(self.options["path"])


class _PcapWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.own = path, os.path.join(path, f"_writing-{uuid.uuid4().hex}")

    def write(self, iterator):
        from pyspark import TaskContext

        os.makedirs(self.own, exist_ok=True)
        # A task that runs twice has a file for each attempt; the driver takes the one that is reported.
        task = TaskContext.get()
        target = os.path.join(self.own, f"part-{task.partitionId():05d}-{task.taskAttemptId()}.pcap")
        n = 0
        with open(target, "wb") as f:
            f.write(PCAP_HEADER)
            for row in iterator:
                f.write(row["record"])
                n += 1
        return _Part(target, n)

    def commit(self, messages):
        done = [m for m in messages if m is not None]
        if missing := [m.path for m in done if not os.path.exists(m.path)]:
            raise FileNotFoundError(f"{missing[0]}: the path is not shared with the executors")
        for m in done:
            os.replace(m.path, os.path.join(self.path, os.path.basename(m.path).rsplit("-", 1)[0] + ".pcap"))
        shutil.rmtree(self.own, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.own, ignore_errors=True)


def write_pcap(packets: DataFrame, path: str) -> int:
    """One capture file of all packets in order, streamed partition by partition through the driver; returns their number."""
    n = 0
    with open(path, "wb") as f:
        f.write(PCAP_HEADER)
        for row in pcap_records(packets).orderBy("wall_time", "number").select("record").toLocalIterator():
            f.write(row.record)
            n += 1
    return n


def write_sigmf(base: str, x: np.ndarray, sample_rate: float, frequency_hz: float, annotations: list[dict] = (), calibrated: bool = False, description: str = "", when: str | None = None) -> None:
    """Complex samples as 16-bit pairs with a JSON description beside them."""
    pairs = np.clip(np.stack([x.real, x.imag], 1) * 2048, -2048, 2047).astype("<i2")
    with open(base + ".sigmf-data", "wb") as f:
        f.write(pairs.tobytes())
    capture = {"core:sample_start": 0, "core:frequency": frequency_hz} | ({"core:datetime": when} if when else {})
    meta = {
        "global": {"core:datatype": "ci16_le", "core:sample_rate": sample_rate, "core:version": "1.0.0", "core:description": description + ("" if calibrated else " UNCALIBRATED"), "core:num_channels": 1},
        "captures": [capture],
        "annotations": sorted(annotations, key=lambda a: a.get("core:sample_start", 0)),
    }
    with open(base + ".sigmf-meta", "w") as f:
        json.dump(meta, f, indent=2)


def write_packet_samples(blocks: DataFrame, base: str, sample_index: int, n_symbols: int, sample_rate: float, frequency_hz: float, around_us: float = 200.0) -> bool:
    """The samples around one packet as a sample capture with the packet marked; False where they are no longer there."""
    from ..dsp.signal import samples
    from .files import sample_range

    pad = int(around_us * 1e-6 * sample_rate)
    count = int(n_symbols * sample_rate / C.SYMBOL_RATE)
    found = sample_range(blocks, sample_index - pad, count + 2 * pad).limit(1).collect()
    if not found:
        return False
    write_sigmf(base, samples(bytes(found[0].iq)), sample_rate, frequency_hz, [{"core:sample_start": pad, "core:sample_count": count, "core:label": "packet"}])
    return True


def write_manifest(path: str, config: dict, counters: dict) -> None:
    with open(path, "w") as f:
        json.dump({"config": config, "counters": counters}, f, indent=2, sort_keys=True, default=str)


def appended_history(history: DataFrame, new: DataFrame, keep: int = C.CALIBRATION_HISTORY) -> DataFrame:
    """Calibration history with new rows, the latest `keep` of all."""
    both = history.unionByName(new, allowMissingColumns=True)
    return both.orderBy(F.desc("ts")).limit(keep)


def write_history(history: DataFrame, path: str, keep: int = C.CALIBRATION_HISTORY) -> None:
    """A calibration history as one JSON list, the latest `keep` rows in order of time."""
    rows = [json.loads(r) for r in history.orderBy(F.desc("ts")).limit(keep).toJSON().collect()]
    with open(path, "w") as f:
        json.dump(rows[::-1], f, indent=2)


def console_report(packets: DataFrame, lost: int = 0, samples: int = 0, most: int = 1000) -> str:
    """Totals and devices as text, most frequent first: the first `most` devices, and how many more there are."""
    from ..operators.stats import device_tally, session_totals

    t = session_totals(packets, F.lit(lost), F.lit(samples)).first()
    lines = [f"packets {t.packets}, check right {t.crc_percent or 0:.1f} %, {t.packets_per_s or 0:.1f}/s, lost {t.lost_percent:.3f} %"]
    devices = device_tally(packets)
    shown = devices.orderBy(F.desc("packets"), "adva").limit(most + 1).collect()
    for r in shown[:most]:
        lines.append(f"{r.adva}  {r.packets:6d}  {r.first_pdu_name}  {r.first_adva_kind}")
    if len(shown) > most:
        lines.append(f"and {devices.count() - most} more devices")
    return "\n".join(lines)
