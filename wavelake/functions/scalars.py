"""Scalar expressions over packet rows: missing values, decibels, channels, cells, rows for export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ADVERTISING_ACCESS_ADDRESS, ADVERTISING_CRC_INIT, MEASUREMENTS
from ..dims import CHANNELS


def finite(x: Column) -> Column:
    """x, or null where it is not a number or infinite: missing values are nulls everywhere inside."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def all_finite(df: DataFrame) -> DataFrame:
    """df with finite() over all its float and double columns; for the edge of a source."""
    return df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema.fields])


def power_db(x: Column) -> Column:
    return 10 * F.log10(F.greatest(x, F.lit(1e-15)))


def amplitude_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-12)))


def channel_to_freq(channel: Column) -> Column:
    """Centre frequency in Hz; an unknown channel is an error."""
    mhz = F.when(channel == 37, 2402).when(channel == 38, 2426).when(channel == 39, 2480).when(channel.between(0, 10), 2404 + 2 * channel).when(channel.between(11, 36), 2406 + 2 * channel)
    return F.coalesce(mhz.cast("double"), F.raise_error(F.concat(F.lit("no channel "), channel.cast("string")))) * 1e6


def freq_to_channel(hz: Column, within: float = 1.0) -> Column:
    """The channel whose centre is nearer than `within` Hz, or null: 40 fixed centres, as one expression."""
    found = F.lit(None).cast("int")
    for c, f in CHANNELS:
        found = F.when(F.abs(hz - f) < within, F.lit(c)).otherwise(found)
    return found


def is_advertising(channel: Column) -> Column:
    return channel.isin(37, 38, 39)


def floor_bin(x: Column, width: float) -> Column:
    """The lower edge of x's bin, rounded down below zero too."""
    return F.floor(x / width) * width


def short_info(df: DataFrame) -> Column:
    c = F.col
    return F.when(c("is_event"), F.coalesce(c("event_text"), F.lit(""))).otherwise(F.coalesce(F.nullif(c("info"), F.lit("")), c("pdu_name"), F.lit("")))


def short_address(adva: Column) -> Column:
    return F.when(F.length(adva) > 8, F.right(adva, F.lit(8))).otherwise(adva)


def row_class() -> Column:
    """What a packet row is marked as: event, spoof, alert, anomaly, crc_fail or plain."""
    alerts = F.coalesce(F.col("alerts"), F.array().cast("array<string>"))
    return (
        F.when(F.col("is_event"), "event")
        .when(F.exists(alerts, lambda a: a.contains("two separated feature clusters")), "spoof")
        .when(F.size(alerts) > 0, "alert")
        .when(F.coalesce(F.col("anomaly_score") > 3.0, F.lit(False)), "anomaly")
        .when(~F.coalesce(F.col("crc_ok"), F.lit(False)), "crc_fail")
        .otherwise("plain")
    )


def in_spec(value: Column, low: Column, high: Column) -> Column:
    """Whether a value keeps its limits; null without a value or without any limit."""
    return F.when(finite(value).isNotNull() & (low.isNotNull() | high.isNotNull()), F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True)))


def general(x: Column, digits: int) -> Column:
    """A number with so many digits that count, without zeros at the end; with an exponent below 1e-4 and from 10 ** digits on."""
    s = F.when(finite(x).isNotNull(), F.format_string(f"%.{digits - 1}e", x))
    power = F.substring_index(s, "e", -1).cast("int")
    bare = lambda t: F.regexp_replace(t, r"\.?0+$", "") if digits > 1 else t
    mantissa = F.substring_index(s, "e", 1)
    plain = s.cast(f"decimal(38,{digits + 4})").cast("string")
    return F.when(x == 0, "0").when((power >= -4) & (power < digits), bare(plain)).otherwise(F.concat(F.when(mantissa.contains("."), bare(mantissa)).otherwise(mantissa), F.lit("e"), F.substring_index(s, "e", -1)))


def format_measurement(m: Column) -> Column:
    """`value +/- uncertainty units  [UNCALIBRATED]` of a measurement struct."""
    spread = F.when(finite(m["uncertainty"]).isNotNull(), F.concat(F.lit(" +/- "), general(m["uncertainty"], 3))).otherwise("")
    units = F.when(F.length(m["units"]) > 0, F.concat(F.lit(" "), m["units"])).otherwise("")
    text = F.concat(general(m["value"], 4), spread, units, F.when(m["calibrated"], "").otherwise("  [UNCALIBRATED]"))
    return F.when(finite(m["value"]).isNull(), "n/a").otherwise(text)


def spec_text(m: Column) -> Column:
    """`low .. high units` of a measurement struct; a dash without limits."""
    number = lambda x: F.when((x == F.floor(x)) & (F.abs(x) < 1e9), x.cast("long").cast("string")).otherwise(general(x, 6))
    low, high = F.coalesce(number(m["spec_low"]), F.lit("-inf")), F.coalesce(number(m["spec_high"]), F.lit("+inf"))
    return F.when(m["spec_low"].isNull() & m["spec_high"].isNull(), "-").otherwise(F.trim(F.concat(low, F.lit(" .. "), high, F.lit(" "), F.coalesce(m["units"], F.lit("")))))


def fixed(x: Column, digits: int) -> Column:
    """A finite number with so many digits (3 at most) after the point: the nearest such text, of two equally near the even one.

    format_string() rounds the shortest decimal that stands for the number, and always up; C and SQL
    round the number itself. Its part below one is a whole number of 2^-63, exactly.
    """
    ten, a = 10**digits, F.abs(x.cast("double"))
    whole = F.floor(a).cast("long")
    part = ((a - whole) * float(1 << 63)).cast("long").cast("decimal(19,0)") * F.lit(ten).cast("decimal(4,0)")
    unit, half = (F.lit(str(1 << k)).cast("decimal(19,0)") for k in (63, 62))
    down = F.call_function("div", part, unit)
    rest = part - down.cast("decimal(4,0)") * unit
    n = whole * ten + down
    n = n + F.when((rest > half) | ((rest == half) & (n % 2 == 1)), 1).otherwise(0)
    text = F.call_function("div", n, F.lit(ten)).cast("string")
    if digits:
        text = F.concat(text, F.lit("."), F.lpad((n % ten).cast("string"), digits, "0"))
    # From 2^52 on all numbers are whole; from 2^63 on they are beyond a long.
    text = F.when(a < float(1 << 52), text).otherwise(F.concat(whole.cast("string"), F.lit("." + "0" * digits if digits else "")))
    return F.when((a == 0) | (a >= float(1 << 63)), F.format_string(f"%.{digits}f", x)).otherwise(F.concat(F.when(x < 0, "-").otherwise(""), text))


def cell(x: Column, digits: int) -> Column:
    """A number as a table shows it: empty where there is none."""
    return F.when(finite(x).isNull(), "").otherwise(fixed(x, digits))


EXPORT = (
    "number timestamp_us wall_time sample_index epoch channel frequency_hz access_address pdu_type pdu_name adva adva_kind tx_add length crc_ok crc_received crc_computed "
    "rssi_dbfs rssi_dbm snr_db noise_floor_dbfs gain_db temperature_c calibrated cluster_id anomaly_score n_antennas aoa_deg antenna_phase_deg alerts info payload_hex"
).split()


def as_row(packets: DataFrame) -> DataFrame:
    """Packet rows as exported: the base columns in order, then each measurement present with its uncertainty.

    A measurement column is a struct (value, uncertainty, ...) named m_<key>; its value stands for a
    base column of the same name.
    """
    have = set(packets.columns)
    own = {k: F.col(f"m_{k}.value") for k in MEASUREMENTS if f"m_{k}" in have}
    special = {
        "access_address": F.format_string("0x%08X", F.col("access_address")) if "access_address" in have else None,
        "crc_received": F.format_string("0x%06X", F.col("crc_received")) if "crc_received" in have else None,
        "crc_computed": F.format_string("0x%06X", F.col("crc_computed")) if "crc_computed" in have else None,
        "tx_add": F.when(F.col("tx_add_random"), "random").otherwise("public") if "tx_add_random" in have else None,
        "alerts": F.array_join("alerts", ";") if "alerts" in have else None,
        "info": short_info(packets) if {"info", "is_event", "event_text"} <= have else None,
        "payload_hex": F.lower(F.hex("payload")) if "payload" in have else None,
    }
    columns = []
    for k in EXPORT:
        value = own.get(k) if k in own else special.get(k) if k in special else F.col(k) if k in have else None
        columns.append((value if value is not None else F.lit(None).cast("string")).alias(k))
    for k, value in own.items():
        if k not in EXPORT:
            columns.append(value.alias(k))
        columns.append(F.col(f"m_{k}.uncertainty").alias(f"{k}_unc"))
    if "features_full" in have:
        columns.append(F.col("features_full"))
    return packets.select(*columns)


class ChannelPlan:
    """A channel with its frequency, access address and check seed; checked when made.

    A frequency alone must be a channel's centre; with a channel it may be off all centres, but not
    another channel's. Data channels need an access address; advertising channels have the standard's.
    """

    def __init__(self, channel: int | None = None, frequency_hz: float | None = None, access_address: int | None = None, crc_init: int | None = None):
        centre_of = None if frequency_hz is None else next((c for c, f in CHANNELS if abs(f - frequency_hz) < 1.0), None)
        if channel is None:
            channel = 37 if frequency_hz is None else centre_of
        if channel is None:
            raise ValueError(f"{frequency_hz} Hz is no channel's centre: a channel is needed for its whitening")
        if not 0 <= channel <= 39:
            raise ValueError(f"no channel {channel}")
        if centre_of not in (None, channel):
            raise ValueError(f"{frequency_hz} Hz is channel {centre_of}, not {channel}")
        standard = channel in (37, 38, 39)
        if not standard and access_address is None:
            raise ValueError(f"data channel {channel} needs its access address")
        self.channel = channel
        self.frequency_hz = dict(CHANNELS)[channel] if frequency_hz is None else float(frequency_hz)
        self.access_address = (ADVERTISING_ACCESS_ADDRESS if access_address is None else access_address) & 0xFFFFFFFF
        self.crc_init = (ADVERTISING_CRC_INIT if crc_init is None else crc_init) & 0xFFFFFF
        if standard and centre_of is not None or standard and frequency_hz is None:
            if (self.access_address, self.crc_init) != (ADVERTISING_ACCESS_ADDRESS, ADVERTISING_CRC_INIT):
                raise ValueError("advertising channels have a fixed access address and check seed")
        self.label = f"ch{channel} ({'adv' if standard else 'data'}) {self.frequency_hz / 1e6:.3f} MHz"
