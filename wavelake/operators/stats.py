"""Aggregates over packet rows. All are partial aggregates on a key: nothing is gathered by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.scalars import finite, floor_bin


def good() -> Column:
    """A packet, no event, with a right check and an address."""
    return (~F.coalesce(F.col("is_event"), F.lit(False))) & F.coalesce(F.col("crc_ok"), F.lit(False)) & (F.coalesce(F.col("adva"), F.lit("")) != "")


def admitted(packets: DataFrame) -> DataFrame:
    """Rows that analysis reads: packets with a right check and an address."""
    return packets.where(good())


def latest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each key by order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def device_tally(packets: DataFrame) -> DataFrame:
    """Good packets of each address, with the type and kind it was first seen with."""
    first = lambda c: F.min_by(c, "number").alias(f"first_{c}")
    return admitted(packets).groupBy("adva").agg(F.count("*").alias("packets"), first("pdu_name"), first("adva_kind"))


def session_totals(packets: DataFrame, lost: Column | None = None, samples: Column | None = None) -> DataFrame:
    """One row: packets, good ones, their share, rate and (given counts of samples) lost share in percent."""
    d = packets.where(~F.col("is_event"))
    span = F.max("wall_time") - F.min("wall_time")
    out = d.agg(F.count("*").alias("packets"), F.count_if("crc_ok").alias("crc_ok"), F.try_divide(100.0 * F.count_if("crc_ok"), F.count("*")).alias("crc_percent"), F.try_divide(F.count("*"), span).alias("packets_per_s"))
    return out if lost is None else out.withColumn("lost_percent", F.coalesce(F.try_divide(100.0 * lost, samples + lost), F.lit(0.0)))


def rssi_stats(packets: DataFrame, history: int = C.HISTORY) -> DataFrame:
    """Mean and population variance of each address's last finite strengths."""
    d = admitted(packets).withColumn("_r", finite(F.col("rssi_dbfs"))).where("_r is not null")
    d = latest(d, ["adva"], "number", history)
    return d.groupBy("adva").agg(F.avg("_r").alias("rssi_mean"), F.when(F.count("*") > 1, F.var_pop("_r")).alias("rssi_variance"))


def intervals(packets: DataFrame, cap: float = C.INTERVAL_CAP_US, history: int = C.HISTORY) -> DataFrame:
    """(adva, number, gap_us): an address's last gaps between packets, without those of zero, below, or over the cap."""
    w = Window.partitionBy("adva").orderBy("number")
    d = admitted(packets).select("adva", "number", (F.col("timestamp_us") - F.lag("timestamp_us").over(w)).alias("gap_us"))
    return latest(d.where((F.col("gap_us") > 0) & (F.col("gap_us") < cap)), ["adva"], "number", history)


def interval_stats(packets: DataFrame) -> DataFrame:
    d = intervals(packets).groupBy("adva")
    return d.agg(F.count("*").alias("gaps"), (F.median("gap_us") / 1000.0).alias("adv_interval_ms"), F.when(F.count("*") >= 4, F.stddev_pop("gap_us") / 1000.0).alias("adv_interval_jitter_ms"))


def delay_uniformity(packets: DataFrame, span_us: float = 10_000.0, least: int = 20) -> DataFrame:
    """How far gaps beyond an address's least one are from uniform over the span (largest distance to rank / n)."""
    own = Window.partitionBy("adva")
    d = intervals(packets).withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= least)
    d = d.withColumn("_d", F.least(F.col("gap_us") - F.min("gap_us").over(own), F.lit(span_us)) / span_us)
    rank = F.row_number().over(own.orderBy("_d", "number"))
    return d.withColumn("_gap", F.abs(F.col("_d") - rank / F.col("_n"))).groupBy("adva").agg(F.max("_gap").alias("adv_delay_uniformity"))


def delivery(packets: DataFrame, width: float = 3.0, least: int = 3) -> DataFrame:
    """Share of right checks by strength, in bins rounded down, of those with enough packets."""
    d = packets.where(~F.col("is_event")).withColumn("_r", finite(F.col("rssi_dbfs"))).where("_r is not null")
    d = d.groupBy(floor_bin(F.col("_r"), width).cast("double").alias("rssi_bin")).agg(F.count_if("crc_ok").alias("ok"), F.count("*").alias("total"))
    return d.where(F.col("total") >= least).select("rssi_bin", (F.col("ok") / F.col("total")).alias("pdr"), "total")


def bit_error_profile(positions: DataFrame) -> DataFrame:
    """(position) rows -> dense (position, errors, share, verdict): where in packets bits are wrong."""
    counts = positions.groupBy("position").agg(F.count("*").alias("errors"))
    top = counts.agg(F.max("position").alias("top"))  # one row
    dense = top.where("top is not null").select(F.explode(F.sequence(F.lit(0), "top")).alias("position"), "top")
    d = dense.join(counts, "position", "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    half = F.floor((F.col("top") + 1) / 2)
    tail = d.agg(F.sum("errors").alias("_all"), F.sum(F.when(F.col("position") >= half, F.col("errors")).otherwise(0)).alias("_tail"))
    share = F.col("_tail") / F.col("_all")
    verdict = F.when(share > 0.7, "late in the packet: a collision, or an emitter that reacts").when(share < 0.3, "early in the packet: synchronisation or the ramp").otherwise("all over the packet: broadband noise")
    return d.join(F.broadcast(tail.withColumn("verdict", verdict))).select("position", "errors", (F.col("errors") / F.col("_all")).alias("share"), "verdict")


def enrollment(packets: DataFrame, packets_needed: int = C.ENROLL_PACKETS, temperatures: int = C.ENROLL_TEMPERATURES, distances: int = C.ENROLL_DISTANCES) -> DataFrame:
    """How far each address's baseline is: packets, whole degrees (half to even) and 6 dB bands seen."""
    d = admitted(packets).groupBy("adva").agg(
        F.count("*").alias("packets"),
        F.count_distinct(F.bround(finite(F.col("temperature_c")), 0)).alias("temperatures"),
        F.count_distinct(F.floor(finite(F.col("rssi_dbfs")) / C.DISTANCE_DB)).alias("distances"),
    )
    short = [F.when(F.col(c) < n, F.format_string(f"%d/{n} {c}", F.col(c))) for c, n in (("packets", packets_needed), ("temperatures", temperatures), ("distances", distances))]
    return d.withColumn("blocking", F.array_compact(F.array(*short))).withColumn("valid", F.size("blocking") == 0)


def baseline(measurements: DataFrame) -> DataFrame:
    """(adva, key, value) -> (adva, key, mean, std, n): sample statistics, missing values left out by key."""
    v = finite(F.col("value"))
    return measurements.groupBy("adva", "key").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def mean_vector(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean of array columns by place, as (key, place, mean): for ramp and delay profiles of one length."""
    d = df.select(key, F.posexplode(vector).alias("place", "_v"))
    return d.groupBy(key, "place").agg(F.avg("_v").alias("mean"))


def circular(df: DataFrame, angle: Column, keys: list[str], least: int = 8) -> DataFrame:
    """Mean direction, resultant and circular spread (radians) of angles."""
    a = finite(angle)
    d = df.groupBy(*keys).agg(F.avg(F.sin(a)).alias("_s"), F.avg(F.cos(a)).alias("_c"), F.count(a).alias("n")).where(F.col("n") >= least)
    r = F.hypot("_s", "_c")
    return d.select(*keys, "n", F.atan2("_s", "_c").alias("mean_rad"), r.alias("resultant"), F.sqrt(-2 * F.ln(F.greatest(r, F.lit(1e-9)))).alias("spread_rad"))


def mean_bearing(packets: DataFrame, history: int = 400) -> DataFrame:
    """Mean bearing and its population spread in degrees of each address's last angles within +-90."""
    d = packets.where(good()).withColumn("_a", F.greatest(F.lit(-90.0), F.least(F.lit(90.0), finite(F.col("aoa_deg"))))).where("aoa_deg is not null and _a is not null")
    d = latest(d, ["adva"], "number", history)
    return d.groupBy("adva").agg(F.degrees(F.atan2(F.avg(F.sin(F.radians("_a"))), F.avg(F.cos(F.radians("_a"))))).alias("bearing_deg"), F.stddev_pop("_a").alias("spread_deg"), F.count("*").alias("n"))


def bearing_histogram(packets: DataFrame, width: float = 6.0) -> DataFrame:
    """Packets by bearing over [-90, 90], the last bin closed, with the radius a polar chart draws."""
    last = int(180 / width) - 1
    a = finite(F.col("aoa_deg"))
    d = packets.where(a.between(-90, 90)).groupBy(F.least(F.floor((a + 90) / width), F.lit(last)).cast("int").alias("bin")).agg(F.count("*").alias("packets"))
    most = d.agg(F.max("packets").alias("_most"))
    return d.join(F.broadcast(most)).select("bin", (F.col("bin") * width - 90).alias("from_deg"), "packets", (0.15 + 0.8 * F.col("packets") / F.col("_most")).alias("radius"))


def noise_floor(df: DataFrame, power: Column, keys: list[str], quantile: float = C.FLOOR_QUANTILE) -> DataFrame:
    """A low quantile (interpolated) of power by key, in dB."""
    d = df.groupBy(*keys).agg(F.percentile(finite(power), quantile).alias("floor"))
    return d.withColumn("floor_db", 10 * F.log10(F.greatest("floor", F.lit(1e-15))))


def calibration_drift(history: DataFrame, key: str) -> DataFrame:
    """First and last finite value of a calibration figure by source and channel, where there are two."""
    d = history.withColumn("_v", finite(F.col(key))).where("_v is not null")
    d = d.groupBy("source", "channel").agg(F.min_by("_v", "ts").alias("first"), F.max_by("_v", "ts").alias("last"), F.count("*").alias("n"))
    return d.where("n >= 2").withColumn("drift", F.col("last") - F.col("first"))


def judged_calibration(c: DataFrame) -> DataFrame:
    """Calibration rows with notes on what was found, and ok.

    A note each on the level, DC, gain ratio, skew, reference clock and temperature, where they are
    known, and on the antennas where both heard packets. Clipping and incoherent antennas are faults.
    """
    low, high = C.PEAK_TARGET
    have = {f.name for f in c.schema.fields}
    v = lambda k: finite(F.col(k)) if k in have else F.lit(None).cast("double")
    yes = lambda k: F.coalesce(F.col(k), F.lit(False)) if k in have else F.lit(False)
    say = F.format_string
    peak, dc, gain, skew, degrees, coherence = (v(k) for k in ("peak_dbfs", "dc_magnitude_dbfs", "gain_imbalance", "quadrature_skew_deg", "temperature_c", "antenna_coherence"))
    heard = v("antenna_packets")
    some = coherence.isNotNull() & (F.coalesce(heard, F.lit(1 if "antenna_packets" not in have else 0)) > 0)
    percent = 100 * F.abs(gain - 1)
    notes = [
        F.when(yes("clipping"), F.when(peak.isNotNull(), say("clips at %.1f dBFS: lower the gain, amplitudes are not valid", peak)).otherwise("clips: lower the gain, amplitudes are not valid"))
        .when(peak > high, say("peak of %.1f dBFS is high: lower the gain by about %.0f dB", peak, peak - (low + high) / 2))
        .when(peak < low - C.PEAK_SLACK, say("peak of %.1f dBFS is low: the gain could be %.0f dB higher", peak, (low + high) / 2 - peak))
        .when(peak.isNotNull(), say("level is good at %.1f dBFS", peak)),
        F.when(dc > C.DC_MOST, say("DC of %.1f dBFS is large, the receiver's own correction is due", dc)).when(dc.isNotNull(), say("DC of %.1f dBFS, taken out", dc)),
        F.when(percent > C.GAIN_MOST_PERCENT, say("gain ratio is off by %.1f %%, much", percent)).when(gain.isNotNull(), say("gain ratio is off by %.2f %%, taken out", percent)),
        F.when(skew.isNotNull(), say("skew of %+.2f degrees, taken out", skew)),
        F.when(yes("calibrated_reference"), "clock is locked to a reference").otherwise("clock has no reference: offsets compare within this session only"),
        F.when(degrees.isNotNull(), say("receiver at %.1f degrees C", degrees)),
        F.when(some & (coherence < C.COHERENCE_FAULT), say("antennas do not hear the same (coherence %.2f): check both", coherence))
        .when(some & (coherence < C.COHERENCE_GOOD), say("antennas agree in part (coherence %.2f): bearings are noisy", coherence))
        .when(some, say("antennas agree (coherence %.2f): subtract their phase offset", coherence)),
    ]
    faults = yes("clipping") | F.coalesce(some & (coherence < C.COHERENCE_FAULT), F.lit(False))
    return c.withColumns({"notes": F.array_compact(F.array(*notes)), "ok": ~faults})


def kurtosis(df: DataFrame, x: str, keys: list[str]) -> DataFrame:
    """Fourth standardised moment (three for a normal distribution) by key."""
    return df.groupBy(*keys).agg((F.kurtosis(finite(F.col(x))) + 3).alias("kurtosis"))
