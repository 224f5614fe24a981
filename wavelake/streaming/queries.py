"""Structured Streaming: packets from block streams, per-address state, windows over event time.

State is keyed: demodulation by session and epoch (the end of the last block and the noise floor), the
analyzer by address (clusters and profiles), each with a time to live if one is given. The same processors run in
batches, so a stream's rows equal a batch's over the same input.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..dsp.demod import DETECTIONS, Receiver, floor_estimate, folded_floor, packets
from ..dsp.signal import samples
from ..dsp.synth import BLOCKS
from ..operators.analysis import CLUSTERED, Device, processed


def _timeout(ttl_ms: int | None) -> str:
    """State that is never dropped, or dropped when a key is silent for so long. The latter keeps a query running for good."""
    return GroupStateTimeout.ProcessingTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout


def block_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Sample blocks as files arrive. Backpressure is the files of a trigger; nothing is dropped."""
    return spark.readStream.schema(BLOCKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def packet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def demodulated(blocks: DataFrame, receiver: Receiver, ttl_ms: int | None = None) -> DataFrame:
    """DETECTIONS of a stream of blocks that arrive in order within a session and epoch."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tail, floor, reach = (bytes(state.get[0]), state.get[1], state.get[2]) if state.exists else (b"", None, -1)
        rows = pd.concat(list(batches)).sort_values("block_index")
        out = []
        for r in rows.itertuples(index=False):
            c = int(r.n_channels)
            if reach != r.first_sample:
                tail = b""  # samples are missing before this block
            floor = folded_floor([floor_estimate(samples(r.iq, c), receiver.sample_rate)], floor)[0]
            raw, halo = tail + r.iq, len(tail) // (4 * c)
            x, first = samples(raw, c), r.first_sample - halo
            for f in packets(x, receiver, floor):
                if f.needed >= halo - 1:
                    second = samples(raw, c, 1)[f.start : f.end].tobytes() if c > 1 else None
                    sync = first + f.sync
                    out.append((r.session, r.epoch, r.channel, r.block_index, sync, sync / receiver.sample_rate * 1e6, r.wall_time, f.peak, f.agreement, f.offset, f.data, f.bits.tobytes(), f.levels.astype(np.float32), first + f.start, x[f.start : f.end].tobytes(), second, 10 * np.log10(max(floor, 1e-15)), r.gain_db, r.temperature_c, r.calibrated, r.frequency_hz, c))
            tail, reach = raw[-4 * c * receiver.halo :], r.first_sample + r.n_samples
        state.update((tail, float(floor if floor is not None else 1e-9), int(reach)))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(out, columns=[k.split()[0] for k in DETECTIONS.split(", ")])

    return blocks.groupBy("session", "epoch").applyInPandasWithState(run, DETECTIONS, "tail binary, floor double, reach long", "append", _timeout(ttl_ms))


def analyzer(whitened: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """CLUSTERED rows of a stream of (adva, number, vector[, profile]) in each address's order."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        device = pickle.loads(bytes(state.get[0])) if state.exists else Device()
        rows = pd.concat(list(batches)).sort_values("number")
        yield processed(device, key[0], rows)
        state.update((pickle.dumps(device),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)

    return whitened.groupBy("adva").applyInPandasWithState(run, CLUSTERED, "device binary", "append", _timeout(ttl_ms))


def packet_rates(stream: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Packets and right checks by tumbling window and channel; rows later than the watermark are left out."""
    d = stream.withWatermark("event_time", late).groupBy(F.window("event_time", f"{seconds} seconds"), "channel")
    return d.agg(F.count("*").alias("packets"), F.count_if("crc_ok").alias("crc_ok")).select(F.col("window.start").alias("start"), "channel", "packets", "crc_ok")


def presence(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches in which an address is heard, parted by silences."""
    d = stream.withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), "adva").agg(F.count("*").alias("packets"))
    return d.select("adva", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "packets")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("event_time", late).dropDuplicatesWithinWatermark(keys)


def delivery(stream: DataFrame, width: float = 3.0) -> DataFrame:
    """Running counts of right checks by strength; for the complete or update mode."""
    from ..functions.scalars import finite, floor_bin

    d = stream.where(~F.col("is_event") & finite(F.col("rssi_dbfs")).isNotNull())
    return d.groupBy(floor_bin(F.col("rssi_dbfs"), width).cast("double").alias("rssi_bin")).agg(F.count_if("crc_ok").alias("ok"), F.count("*").alias("total"))


def collected(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """A stream of files run to its end into a table in memory; for tests and small results."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def to_parquet(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds"):
    """A running query that appends a stream's rows to files, each once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()
