"""Lookup tables: fixed values of the radio standard, small enough to broadcast by construction."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Packet types by number.
PDU_TYPES = {
    0x00: "ADV_IND",
    0x01: "ADV_DIRECT_IND",
    0x02: "ADV_NONCONN_IND",
    0x03: "SCAN_REQ",
    0x04: "SCAN_RSP",
    0x05: "CONNECT_IND",
    0x06: "ADV_SCAN_IND",
    0x07: "ADV_EXT_IND",
    0x08: "AUX_CONNECT_RSP",
}
# Types of advertising data by number.
AD_TYPES = {
    0x01: "Flags",
    0x02: "Incomplete 16-bit UUIDs",
    0x03: "Complete 16-bit UUIDs",
    0x04: "Incomplete 32-bit UUIDs",
    0x05: "Complete 32-bit UUIDs",
    0x06: "Incomplete 128-bit UUIDs",
    0x07: "Complete 128-bit UUIDs",
    0x08: "Shortened Local Name",
    0x09: "Complete Local Name",
    0x0A: "Tx Power Level",
    0x0D: "Class of Device",
    0x10: "Device ID",
    0x12: "Peripheral Connection Interval Range",
    0x14: "16-bit Service Solicitation",
    0x16: "Service Data (16-bit)",
    0x19: "Appearance",
    0x1A: "Advertising Interval",
    0x1B: "LE Device Address",
    0x20: "Service Data (32-bit)",
    0x21: "Service Data (128-bit)",
    0x24: "URI",
    0x2D: "Mesh Message",
    0x3D: "3D Information Data",
    0xFF: "Manufacturer Specific",
}
# Makers by number.
COMPANIES = {
    0x0006: "Microsoft",
    0x004C: "Apple",
    0x0075: "Samsung",
    0x00E0: "Google",
    0x0087: "Garmin",
    0x0157: "Huawei",
    0x0171: "Amazon",
    0x0499: "Ruuvi",
    0x05A7: "Sonos",
    0x038F: "Xiaomi",
}
# The labels of the flag bits, from the lowest.
FLAGS = ("LE Limited Discoverable", "LE General Discoverable", "BR/EDR Not Supported", "Simultaneous LE+BR/EDR (Controller)", "Simultaneous LE+BR/EDR (Host)")


def channel_mhz(channel: int) -> int:
    """Centre of a channel; the three advertising channels lie apart from the data channels."""
    if channel in (37, 38, 39):
        return {37: 2402, 38: 2426, 39: 2480}[channel]
    if not 0 <= channel <= 36:
        raise ValueError(f"no channel {channel}")
    return (2404 if channel <= 10 else 2428 - 22) + 2 * channel


CHANNELS = tuple((c, channel_mhz(c) * 1e6) for c in range(40))


def keystream(channel: int, n: int) -> bytes:
    """n bytes of a channel's whitening sequence (x^7 + x^4 + 1, least significant bit first)."""
    state = 0x40 | channel  # one, then the channel's six bits
    out = bytearray()
    for _ in range(n):
        byte = 0
        for bit in range(8):
            out_bit = state & 1
            byte |= out_bit << bit
            state >>= 1
            if out_bit:
                state ^= 0x44
        out.append(byte)
    return bytes(out)


def lookup(names: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*names.items())]), key)


def channels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHANNELS), "channel int, frequency_hz double")
