"""From sample blocks to packet rows: the whole path as one plan, for batches and streams alike."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..dsp.demod import DETECTIONS, Receiver, demodulate, demodulated_in_order
from ..dsp.measure import MEASURED, measure, measured
from ..functions.bytes import parse_pdu
from ..operators.windows import running_sums


#: Columns of a detection that stay in packet rows: all but its samples and symbols, and what tells it apart.
KEPT = tuple(k for k in DETECTIONS.split(", ") if k.split()[0] not in ("session", "epoch", "abs_sync", "slice", "slice_2", "bits", "levels"))
_KEPT = [k.split()[0] for k in KEPT]
#: Rows of measured_in_order().
FOUND = ", ".join([MEASURED, *KEPT])


def packet_rows(blocks: DataFrame, receiver: Receiver = Receiver(), full: bool = True, rssi_cal_db: float | None = None, antenna_cal_rad: float = 0.0, block_samples: int = 16_384) -> DataFrame:
    """Decoded and measured packets of sample blocks; numbers count a session's packets in order of sample.

    Samples are decoded once, and measured row by row. No column of samples is kept.
    """
    return described(measure(demodulate(blocks, receiver, block_samples), receiver.sample_rate, rssi_cal_db, antenna_cal_rad, full, _KEPT), receiver)


def measured_in_order(batches: Iterator[pd.DataFrame], receiver: Receiver = Receiver(), full: bool = True, rssi_cal_db: float | None = None, antenna_cal_rad: float = 0.0) -> Iterator[pd.DataFrame]:
    """Frames of blocks in order, those of a session and epoch one after the other -> frames of FOUND, for described()."""
    return measured(demodulated_in_order(batches, receiver), receiver.sample_rate, rssi_cal_db, antenna_cal_rad, full, _KEPT)


def described(found: DataFrame, receiver: Receiver = Receiver()) -> DataFrame:
    """Rows of FOUND -> packet rows, with the fields of their bytes."""
    m = [k.split()[0] for k in MEASURED.split(", ")]
    p = parse_pdu(found).withColumnsRenamed({"abs_sync": "sample_index"})
    fields = [F.col(f"decoded.{k}").alias(k) for k in ("pdu_type", "pdu_name", "tx_add_random", "rx_add_random", "length", "adva_kind", "payload", "ad_structures", "info", "crc_received", "crc_computed", "crc_ok")]
    out = p.select("session", "epoch", "sample_index", *[k for k in _KEPT if k != "pdu"], *fields, F.col("decoded.adva_str").alias("adva"), F.col("decoded.raw").alias("raw_bytes"), *m[3:])
    return out.withColumn("is_event", F.lit(False)).withColumn("event_kind", F.lit("")).withColumn("event_text", F.lit("")).withColumn("access_address", F.lit(receiver.access_address).cast("long")).withColumn("alerts", F.array().cast("array<string>"))


def numbered(packets: DataFrame, span: int = 1 << 30) -> DataFrame:
    """packets with `number`: 1, 2, ... in each session by epoch and sample, counted in stretches of `span` samples."""
    d = running_sums(packets, {"_own": F.lit(1)}, "sample_index", ["session", "epoch"], span)
    w = Window.partitionBy("session").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    epochs = packets.groupBy("session", "epoch").agg(F.count("*").alias("_n")).select("session", "epoch", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return d.join(epochs, ["session", "epoch"]).select(*packets.columns, (F.col("_before") + F.col("_own")).cast("long").alias("number"))


#: Measurements that are looked at for two modes: the vector's and the bearing.
BIMODAL = (*C.VECTOR, "aoa_deg")


def analyze(packets: DataFrame, enroll: tuple[str, ...] = (), threshold: float = C.ANOMALY_ALERT, needed: tuple[int, int, int] = (C.ENROLL_PACKETS, C.ENROLL_TEMPERATURES, C.ENROLL_DISTANCES)) -> DataFrame:
    """Packet rows with cluster_id, anomaly_score, contributions and alerts, as a batch.

    Each session, if packets have that column, is analysed by itself, in order of number: vectors are
    whitened by the session's running moments and clustered in each address's order, clusters are
    labelled as they appear in it, enrolled addresses are scored against their baseline as it is at
    each packet. A packet's alerts are, in this order: two clusters, two modes of a measurement, too
    many packets at once, a baseline left, a delay profile left. Needed: packets, whole degrees and
    bands of strength that make a baseline valid.
    """
    from ..operators import analysis, stats, windows

    have = set(packets.columns)
    by = ["session"] if "session" in have else []
    own = [*by, "adva", "number"]
    good = stats.admitted(packets)
    white = windows.whitened(good.select(*own, *C.VECTOR, *observed(packets)), list(C.VECTOR), "number", vector="vector", by=by).select(*own, "vector", "profile", "values")
    clusters = analysis.cluster_labels(analysis.clustered(white, BIMODAL, by), by)
    kinds = ["cluster_alert", "bimodal_alert", "multipath_alert"]
    out = packets.drop("alerts").join(clusters.select(*own, "cluster_id", "separation", *kinds), own, "left")
    burst = windows.bursts(packets, by=by).where("burst").select(*own, "recent")
    out = out.join(burst, own, "left")
    if enroll:
        mine = good.where(enrolled(enroll))
        mine = mine if "calibrated" in have else mine.withColumn("calibrated", F.lit(False))
        scores = analysis.running_scores(mine, needed=needed, by=by).select(*own, "anomaly_score", "anomaly_contributions", "valid")
        out = out.drop("anomaly_score", "anomaly_contributions").join(scores, own, "left")
    else:
        none = {"anomaly_score": "double", "anomaly_contributions": "map<string,double>", "valid": "boolean"}
        out = out.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return with_alerts(out, threshold)


def observed(packets: DataFrame) -> list[Column]:
    """profile and values (those of BIMODAL) of packets, null where they have no such columns."""
    have, none = set(packets.columns), F.lit(None).cast("double")
    profile = F.col("profile") if "profile" in have else F.lit(None).cast("array<float>").alias("profile")
    return [profile, F.array(*[F.col(k).cast("double") if k in have else none for k in BIMODAL]).alias("values")]


def enrolled(addresses: tuple[str, ...]) -> Column:
    return F.upper("adva").isin(*[a.upper() for a in addresses])


def with_alerts(found: DataFrame, threshold: float = C.ANOMALY_ALERT) -> DataFrame:
    """Rows with what each test has found -> with alerts, in order, in place of it; recent is null where there is no burst."""
    from ..operators.analysis import baseline_alert

    tests = ["cluster_alert", "bimodal_alert", "burst_alert", "baseline_alert", "multipath_alert"]
    d = found.withColumns({"burst_alert": F.when(F.col("recent").isNotNull(), F.format_string("%d packets of %s at once", "recent", "adva")), "baseline_alert": baseline_alert(threshold)})
    return d.withColumn("alerts", F.array_compact(F.array(*tests))).drop(*tests, "recent", "valid")


def controlled(blocks: DataFrame, commands: DataFrame) -> DataFrame:
    """Blocks with the gain in force at their time, and `counter`: how many clear commands were given by then.

    commands: (session, effective_from, kind, gain_db), kind gain or clear, a row for each. Totals by
    counter start anew at each clear.
    """
    from ..operators.joins import as_of

    w = Window.partitionBy("session").orderBy("effective_from")
    steps = commands.select("session", F.col("effective_from").alias("wall_time"), F.struct(F.last(F.when(F.col("kind") == "gain", F.col("gain_db")), ignorenulls=True).over(w).alias("gain"), F.count_if(F.col("kind") == "clear").over(w).alias("clears")).alias("_set"))
    d = as_of(blocks, steps, ["session"], "wall_time", "_set", "_now")
    return d.withColumns({"gain_db": F.coalesce(F.col("_now.gain"), F.col("gain_db")).cast("int"), "counter": F.coalesce(F.col("_now.clears"), F.lit(0)).cast("long")}).drop("_now")


def tuned(blocks: DataFrame, plan: DataFrame) -> DataFrame:
    """Blocks with the channel, frequency and epoch in force at their time.

    plan: (session, effective_from, channel, frequency_hz), a row for each retune; epochs count them.
    """
    from ..operators.joins import as_of

    w = Window.partitionBy("session").orderBy("effective_from")
    steps = plan.withColumn("_epoch", F.row_number().over(w) - 1)
    row = steps.select("session", F.col("effective_from").alias("wall_time"), F.struct("channel", "frequency_hz", "_epoch").alias("_plan"))
    d = as_of(blocks, row, ["session"], "wall_time", "_plan", "_now")
    return d.withColumn("channel", F.coalesce("_now.channel", "channel")).withColumn("frequency_hz", F.coalesce("_now.frequency_hz", "frequency_hz")).withColumn("epoch", F.coalesce(F.col("_now._epoch"), F.col("epoch")).cast("int")).drop("_now")


def retune_events(plan: DataFrame) -> DataFrame:
    """Event rows of a plan, to stand among packets."""
    text = F.format_string("retuned to channel %d (%.0f MHz)", F.col("channel"), F.col("frequency_hz") / 1e6)
    return plan.select("session", F.col("effective_from").alias("wall_time"), "channel", "frequency_hz", F.lit(True).alias("is_event"), F.lit("retune").alias("event_kind"), text.alias("event_text"), F.lit(False).alias("crc_ok"))
