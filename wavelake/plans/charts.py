"""What charts and tables show, as queries over packets and blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..dsp.blocks import power_spectra
from ..functions.scalars import cell, finite, short_info
from ..operators import ordering, stats, windows
from ..tables import held


def spectrum(blocks: DataFrame, sample_rate: float, size: int = 1024) -> DataFrame:
    """Frequency, power and held peak of each block's spectrum."""
    d = power_spectra(blocks, sample_rate, size).withColumn("_key", F.concat_ws("/", "session", "epoch", "bin"))
    return windows.peak_hold(d, "_key", "block_index", "power_dbfs").withColumnRenamed("peak", "peak_hold_dbfs").drop("_key")


def waterfall(blocks: DataFrame, sample_rate: float, rows: int = 200, range_db: float = 45.0, size: int = 1024) -> DataFrame:
    """The last spectra of each session as levels 0 to 1 below a top that follows the 99.9th percentile slowly."""
    # Only blocks that have a spectrum count. The last of each session is one row, so no session's blocks are gathered to find it.
    whole = blocks.where(F.octet_length("iq") >= 4 * size * F.col("n_channels"))
    ends = whole.groupBy("session", "epoch").agg(F.max("block_index").alias("_end")).withColumnsRenamed({"session": "_session", "epoch": "_epoch"})
    same = F.col("session").eqNullSafe(F.col("_session")) & F.col("epoch").eqNullSafe(F.col("_epoch")) & (F.col("block_index") > F.col("_end") - rows)
    d = held(power_spectra(whole.join(F.broadcast(ends), same).select(*blocks.columns), sample_rate, size))
    tops = d.groupBy("session", "epoch", "block_index").agg(F.percentile("power_dbfs", 0.999).alias("_t"))
    w = Window.partitionBy("session", "epoch").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    follow = F.aggregate(F.collect_list("_t").over(w), F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(0.9 * a + 0.1 * x))  # at most `rows` values
    tops = tops.withColumn("top_dbfs", follow).drop("_t")
    level = (F.col("power_dbfs") - F.col("top_dbfs") + range_db) / range_db
    return d.join(tops, ["session", "epoch", "block_index"]).withColumn("level", F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)))


def series(packets: DataFrame, value: str, focus: str | None = None) -> DataFrame:
    """(adva, time_s, value, segment) of the busiest addresses' last values, parted at gaps."""
    d = ordering.series(stats.admitted(packets), value, focus=focus)
    return windows.gap_segments(d, ["adva"], "time_s", "number").select("adva", "number", "time_s", "value", "segment")


def cfo_series(packets: DataFrame, focus: str | None = None) -> DataFrame:
    return series(packets, "cfo_ppm", focus)


def rssi_series(packets: DataFrame, focus: str | None = None) -> DataFrame:
    return series(packets, "rssi_dbfs", focus)


def scatter(packets: DataFrame, x: str, y: str, rows: int = C.SCATTER_ROWS) -> DataFrame:
    """(adva, cluster, x, y) of the last packets that have both."""
    d = packets.where(~F.col("is_event") & F.col("crc_ok") & finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull())
    return ordering.retained(d, rows).select("adva", "number", *([F.col("cluster_id").alias("cluster")] if "cluster_id" in d.columns else [F.lit(-1).alias("cluster")]), F.col(x).alias("x"), F.col(y).alias("y"))


def ellipses(base: DataFrame, x: str, y: str, least: int = C.BASELINE_LEAST) -> DataFrame:
    """Baseline boxes of one and two deviations in two features."""
    a, b = (base.where((F.col("key") == k) & (F.col("n") >= least)).select("adva", F.col("mean").alias(f"{s}_mean"), F.col("std").alias(f"{s}_std")) for k, s in ((x, "x"), (y, "y")))
    d = a.join(b, "adva").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    return d.select("adva", "k", *[(F.col(f"{s}_mean") + sign * F.col("k") * F.col(f"{s}_std")).alias(f"{s}_{side}") for s in "xy" for sign, side in ((-1, "low"), (1, "high"))])


def packet_trace(detections: DataFrame, sample_rate: float) -> DataFrame:
    """(abs_sync, time_s, frequency_hz, envelope) of each sample of packets; frequency is null outside the burst."""
    from ..dsp.signal import frequency

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                x = np.frombuffer(r.slice, np.complex64)
                f = np.append(frequency(x, sample_rate), np.nan)
                a = r.abs_sync - r.abs_slice_start
                z = a + r.sym_offset + len(r.bits) * sample_rate / C.SYMBOL_RATE
                at = np.arange(len(x))
                f = np.where((at >= a) & (at < z), f, np.nan)
                yield pd.DataFrame({"session": r.session, "abs_sync": r.abs_sync, "time_s": (r.abs_slice_start + at) / sample_rate, "frequency_hz": pd.Series(f, dtype=object).where(np.isfinite(f), None), "envelope": np.abs(x).astype(float)})

    return detections.select("session", "abs_sync", "abs_slice_start", "sym_offset", "bits", "slice").mapInPandas(run, "session string, abs_sync long, time_s double, frequency_hz double, envelope double")


def eye(detections: DataFrame, sample_rate: float, traces: int = 120) -> DataFrame:
    """(abs_sync, trace, x, y): a packet's frequency folded at two symbols."""
    from ..dsp.signal import frequency

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                f = frequency(np.frombuffer(r.slice, np.complex64), sample_rate)
                sps = sample_rate / C.SYMBOL_RATE
                n = int(2 * sps)
                start = r.abs_sync - r.abs_slice_start + r.sym_offset - sps / 2
                first = np.rint(start + np.arange(min(traces, len(r.bits) // 2)) * 2 * sps).astype(int)
                first = first[(first >= 0) & (first + n <= len(f))]
                at = first[:, None] + np.arange(n)
                yield pd.DataFrame({"session": r.session, "abs_sync": r.abs_sync, "trace": np.repeat(np.arange(len(first)), n), "x": np.tile(np.arange(n) / sps, len(first)), "y": f[at].reshape(-1).astype(float)})

    return detections.select("session", "abs_sync", "abs_slice_start", "sym_offset", "bits", "slice").mapInPandas(run, "session string, abs_sync long, trace long, x double, y double")


def direction(packets: DataFrame, sigma: float = 2.5) -> dict[str, DataFrame]:
    """Points, mean rays, density, and addresses whose bearings fall in two."""
    good = stats.admitted(packets)
    split = windows.two_mode_split(good, ["adva"], "aoa_deg", least=40, trim=1).where(F.col("sigma") >= sigma)
    return {"points": good.where(finite(F.col("aoa_deg")).isNotNull()).select("adva", "number", "aoa_deg", "rssi_dbfs"), "rays": stats.mean_bearing(packets), "density": stats.bearing_histogram(good), "split": split}


def noise_and_delivery(blocks: DataFrame, packets: DataFrame, rows: int = C.NOISE_ROWS, width: float = 3.0) -> DataFrame:
    """(session, series, x, y): the noise floor where it changes, and delivery by strength; a row of null y breaks the line.

    Floors break where the epoch changes, and the last `rows` points of a session stay; delivery breaks
    where bins are missing.
    """
    d = windows.change_points(blocks, ["session"], "block_index", "noise_floor_dbfs", epoch="epoch")
    d = d.withColumn("_point", F.explode(F.array_compact(F.array(F.when(F.col("new_epoch"), 0), F.when(F.col("moved"), 1)))))
    w = Window.partitionBy("session").orderBy(F.desc("block_index"), F.desc("_point"))
    d = d.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= rows)
    noise = d.select("session", F.lit("noise_floor_dbfs").alias("series"), F.col("block_index").cast("double").alias("x"), F.when(F.col("_point") == 1, F.col("noise_floor_dbfs")).alias("y"))
    p = windows.bin_breaks(stats.delivery(packets, width), "rssi_bin", width)
    p = p.withColumn("_point", F.explode(F.when(F.col("break_before"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    pdr = p.select(F.lit(None).cast("string").alias("session"), F.lit("pdr").alias("series"), F.when(F.col("_point") == 1, F.col("rssi_bin")).alias("x"), F.when(F.col("_point") == 1, F.col("pdr")).alias("y"))
    return noise.unionByName(pdr)


#: The packet table's columns, with the title that a view shows and whether numbers stand right.
TABLE = (
    ("number", "#", True), ("time_us", "Time (us)", True), ("clock", "Abs time", False), ("channel", "Ch", True), ("pdu_type", "PDU type", False), ("adva", "AdvA", False), ("tx_add", "TxAdd", False), ("length", "Len", True),
    ("rssi", "RSSI (dBFS)", True), ("cfo_ppm", "CFO (ppm) *", True), ("mod_index", "Mod idx", True), ("crc", "CRC", False), ("cluster", "Cluster", True), ("anomaly", "Anomaly", True), ("aoa_deg", "AoA (deg)", True), ("phase_deg", "d-phi (deg)", True), ("info", "Info", False),
)


def packet_table(packets: DataFrame, rows: int = C.TABLE_ROWS, dbm: bool = False, calibrated: bool = False) -> DataFrame:
    """The packet list: the last rows as text cells, events with their kind and text alone.

    Columns carry their title and side as metadata; units that hold for all rows stand there: dBm
    where strengths are calibrated, a star where the clock is not.
    """
    d = ordering.retained(packets, rows)
    have = set(d.columns)
    v = lambda k: F.col(k) if k in have else F.lit(None).cast("double")
    event = F.coalesce(F.col("is_event"), F.lit(False))
    cells = {
        "number": F.col("number").cast("string"), "time_us": cell(v("timestamp_us"), 0), "clock": F.date_format(F.timestamp_seconds("wall_time"), "HH:mm:ss"), "channel": F.col("channel").cast("string"),
        "pdu_type": F.when(event, F.col("event_kind")).otherwise(F.col("pdu_name")), "adva": F.col("adva"), "tx_add": F.col("adva_kind"), "length": F.col("length").cast("string"),
        "rssi": cell(F.coalesce(finite(v("rssi_dbm")), v("rssi_dbfs")), 1), "cfo_ppm": cell(v("cfo_ppm"), 2), "mod_index": cell(v("modulation_index"), 3), "crc": F.when(F.col("crc_ok"), "OK").otherwise("FAIL"),
        "cluster": F.when(v("cluster_id") >= 0, v("cluster_id").cast("int").cast("string")), "anomaly": cell(v("anomaly_score"), 2), "aoa_deg": cell(v("aoa_deg"), 1), "phase_deg": cell(v("antenna_phase_deg"), 1), "info": short_info(d),
    }
    titles = {"rssi": "RSSI (dBm)"} if dbm else {}
    titles |= {"cfo_ppm": "CFO (ppm)"} if calibrated else {}
    out = []
    for name, title, right in TABLE:
        c = cells[name] if name in ("number", "time_us", "channel", "pdu_type", "info") else F.when(event, "").otherwise(cells[name])
        out.append(F.coalesce(c, F.lit("")).alias(name, metadata={"title": titles.get(name, title), "align": "right" if right else "left"}))
    return d.select(*out)


def detail(packets: DataFrame) -> DataFrame:
    """(number, path, name, value, byte_start, byte_len): what a packet is made of, as a long table."""
    def row(path, name, value, start=None, n=None):
        return F.struct(F.lit(path).alias("path"), F.lit(name).alias("name"), value.cast("string").alias("value"), F.lit(start).cast("int").alias("byte_start"), (F.lit(n).cast("int") if n is None or isinstance(n, int) else n.cast("int")).alias("byte_len"))

    c = F.col
    rows = [
        row("Frame", "number", c("number")), row("Frame", "time_us", c("timestamp_us")), row("Radio", "channel", c("channel")), row("Radio", "rssi_dbfs", c("rssi_dbfs")), row("Link", "type", c("pdu_name"), 0, 1), row("Link", "length", c("length"), 1, 1),
        row("Link", "address", c("adva"), 2, 6), row("Link", "address kind", c("adva_kind")), row("Link", "payload", F.lower(F.hex("payload")), 2, F.octet_length("payload")), row("CRC", "received", F.format_string("0x%06X", c("crc_received"))), row("CRC", "right", c("crc_ok")),
    ]
    fixed = packets.select("number", F.inline(F.array(*rows)))
    ad = packets.select("number", F.posexplode("ad_structures").alias("_i", "_a")).select("number", F.concat(F.lit("AD/"), c("_i").cast("string")).alias("path"), c("_a.name").alias("name"), c("_a.value").alias("value"), F.lit(None).cast("int").alias("byte_start"), F.octet_length("_a.raw").alias("byte_len"))
    expert = packets.select("number", F.posexplode("alerts").alias("_i", "value")).select("number", F.lit("Expert").alias("path"), F.lit("alert").alias("name"), "value", F.lit(None).cast("int").alias("byte_start"), F.lit(None).cast("int").alias("byte_len"))
    return fixed.unionByName(ad).unionByName(expert)


def status(packets: DataFrame, lost: int = 0, samples: int = 0) -> DataFrame:
    return stats.session_totals(packets, F.lit(lost), F.lit(samples))


def saved(chart: DataFrame, path: str) -> None:
    """A chart's rows as CSV; one without rows is an error."""
    if chart.isEmpty():
        raise ValueError("the chart has no rows")
    chart.write.mode("overwrite").option("header", "true").csv(path)
