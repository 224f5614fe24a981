"""Bytes of a packet as column expressions: checks, whitening, addresses, headers, advertising data."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import ADVERTISING_CRC_INIT, CRC_POLYNOMIAL_REFLECTED
from ..dims import AD_TYPES, COMPANIES, FLAGS, PDU_TYPES, keystream, lookup

#: Bytes after which a keystream starts anew.
PERIOD = 127


def byte_array(data: Column) -> Column:
    """A binary as an array of ints 0 to 255."""
    n = F.octet_length(data)
    one = lambda i: F.conv(F.hex(F.substr(data, i + 1, F.lit(1))), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).when(n == 0, F.array().cast("array<int>"))


def from_bytes(values: Column) -> Column:
    """An array of ints 0 to 255 as a binary."""
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def at_byte(data: Column, k) -> Column:
    """Byte k of a binary, from 0; null past its end."""
    k = F.lit(k) if isinstance(k, int) else k
    piece = F.hex(F.substr(data, k + 1, F.lit(1)))
    return F.conv(F.nullif(piece, F.lit("")), 16, 10).cast("int")


def little_endian(data: Column, n: int) -> Column:
    """The unsigned number in the first n bytes, lowest first."""
    return sum((F.shiftleft(at_byte(data, k).cast("long"), 8 * k) for k in range(1, n)), at_byte(data, 0).cast("long"))


@lru_cache(1)
def _crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (CRC_POLYNOMIAL_REFLECTED if value & 1 else 0)
        out.append(value)
    return out


def reflect24(value: Column | int) -> Column | int:
    """A 24-bit number with its bits in reverse."""
    if isinstance(value, int):
        return int(f"{value & 0xFFFFFF:024b}"[::-1], 2)
    return F.conv(F.reverse(F.lpad(F.bin(value.cast("long").bitwiseAND(F.lit(0xFFFFFF))), 24, "0")), 2, 10).cast("long")


def crc24(values: Column, init: int = ADVERTISING_CRC_INIT) -> Column:
    """The packet check of an array of bytes, folded through a table of 256 entries."""
    table = F.array(*[F.lit(x) for x in _crc_table()])
    step = lambda c, x: F.shiftright(c, 8).bitwiseXOR(F.element_at(table, c.bitwiseXOR(x).bitwiseAND(F.lit(255)) + 1))
    return F.aggregate(values, F.lit(reflect24(init)), step).cast("long")


def crc24_bytes(crc: Column) -> Column:
    """A check as its three bytes on air, lowest first."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftright(crc, 8 * k).bitwiseAND(F.lit(255)).cast("long")), 2, "0") for k in range(3)]))


def crc24_from_air(data: Column) -> Column:
    return little_endian(data, 3)


def dewhitened(values: Column, channel: Column) -> Column:
    """An array of bytes xored with its channel's keystream; applying it twice gives the bytes back."""
    streams = F.lit(b"".join(keystream(c, PERIOD) for c in range(40)))
    round_ = F.hex(F.substr(streams, channel.cast("int") * PERIOD + 1, F.lit(PERIOD)))
    own = F.unhex(F.repeat(round_, F.ceil(F.size(values) / PERIOD).cast("int")))
    return F.zip_with(values, byte_array(F.substr(own, F.lit(1), F.size(values))), lambda a, b: a.bitwiseXOR(b))


def bits_to_bytes(bits: Column) -> Column:
    """Whole bytes of an array of bits, lowest bit first."""
    n = F.floor(F.size(bits) / 8).cast("int")
    one = lambda i: F.aggregate(F.reverse(F.slice(bits, 8 * i + 1, 8)), F.lit(0), lambda s, b: s * 2 + b.cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), one)).otherwise(F.array().cast("array<int>"))


def bytes_to_bits(values: Column) -> Column:
    return F.flatten(F.transform(values, lambda v: F.array(*[F.shiftright(v, k).bitwiseAND(F.lit(1)) for k in range(8)])))


def format_address(address: Column) -> Column:
    """Six bytes as upper-case hex in reverse, parted by colons."""
    h = F.hex(address)
    return F.when(F.octet_length(address) == 6, F.concat_ws(":", *[F.substring(h, k, 2) for k in range(11, 0, -2)]))


def address_kind(address: Column, random: Column) -> Column:
    top = F.shiftright(at_byte(address, 5), 6)
    kind = F.when(top == 3, "random static").when(top == 1, "resolvable private").when(top == 0, "non-resolvable private").otherwise("random (reserved)")
    return F.when(~random, "public").when(F.octet_length(address) != 6, "random").otherwise(kind)


AD_ITEM = T.StructType([T.StructField("type", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("raw", T.BinaryType()), T.StructField("value", T.StringType()), T.StructField("truncated", T.BooleanType())])


def ad_value(kind: int, raw: bytes) -> str:
    """The readable form of one item of advertising data; hex where there is none."""
    number = int.from_bytes(raw[:2], "little")
    if kind in (0x08, 0x09):
        return raw.decode("utf-8", "replace")
    if kind == 0x01 and raw:
        named = [label for k, label in enumerate(FLAGS) if raw[0] >> k & 1]
        return f"0x{raw[0]:02X}" + (" | " + ", ".join(named) if named else "")
    if kind == 0x0A and raw:
        return f"{(raw[0] ^ 0x80) - 0x80} dBm"
    if len(raw) >= 2:
        if kind == 0x19:
            return f"0x{number:04X}"
        if kind == 0x1A:
            return f"{number * 0.625:.1f} ms"
        if kind in (0x02, 0x03, 0x14):
            return ", ".join(f"0x{x:04X}" for x in np.frombuffer(raw[: len(raw) // 2 * 2], "<u2").tolist())
        if kind == 0x16:
            return f"UUID 0x{number:04X}, {raw[2:].hex()}"
        if kind == 0xFF:
            return f"{COMPANIES.get(number, f'0x{number:04X}')}: {raw[2:].hex()}"
    return raw.hex()


def ad_items(payload: bytes | None) -> list[tuple] | None:
    """Items of advertising data up to a length of zero; one that runs over the end is a truncated last item."""
    if payload is None:
        return None
    out, data, at = [], bytes(payload), 0
    while at < len(data) and data[at]:
        end = at + data[at] + 1
        if end > len(data):
            out.append((None, "Truncated AD structure", data[at:], None, True))
            break
        kind, raw = data[at + 1], data[at + 2 : end]
        out.append((kind, AD_TYPES.get(kind, f"Unknown (0x{kind:02X})"), raw, ad_value(kind, raw), False))
        at = end
    return out


#: Bytes of payloads whose items are held at a time.
PARSED_BYTES = 1 << 20


def stretches(payloads: pd.Series, most: int) -> Iterator[pd.Series]:
    """A series of payloads in order, in pieces of at most so many bytes, or of one payload."""
    first = total = 0
    for k, x in enumerate(payloads):
        n = 0 if x is None else len(x)
        if k > first and total + n > most:
            yield payloads.iloc[first:k]
            first, total = k, 0
        total += n
    yield payloads.iloc[first:]


@F.pandas_udf(T.ArrayType(AD_ITEM))
def parse_ad(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Advertising data as an array of items, in Arrow batches: its walk has no end known beforehand.

    A batch is answered in stretches of so many bytes (or one payload), since items take many times
    their payload's bytes in Python.
    """
    for batch in payloads:
        for part in stretches(batch, PARSED_BYTES):
            yield part.map(ad_items)


def parse_pdu(df: DataFrame, data: str = "pdu", init: int = ADVERTISING_CRC_INIT) -> DataFrame:
    """df with `decoded`: the fields of the packets (header, payload, check) in a binary column.

    All fixed fields are column expressions. Packets under five bytes or shorter than their length
    field are not ok and have an error. The first six bytes of requests are the sender's address too,
    as they are of advertisements; the second six are target_a.
    """
    raw = F.col(data)
    head, length = at_byte(raw, 0), at_byte(raw, 1)
    runt = F.octet_length(raw) < 5
    long = ~runt & (length + 5 > F.octet_length(raw))
    ok = ~runt & ~long
    kind = head.bitwiseAND(F.lit(15))
    flag = lambda bit: F.coalesce(ok & (head.bitwiseAND(F.lit(bit)) != 0), F.lit(False))
    name = F.coalesce(lookup(PDU_TYPES, kind), F.concat(F.lit("RFU(0x"), F.lpad(F.hex(kind.cast("long")), 2, "0"), F.lit(")")))
    payload = F.substr(raw, F.lit(3), length)
    received = little_endian(F.substr(raw, length + 3, F.lit(3)), 3)
    computed = crc24(byte_array(F.substr(raw, F.lit(1), length + 2)), init)
    d = df.withColumn("_kind", F.when(~runt, kind)).withColumn("_payload", F.when(ok, payload)).withColumn("_rx", F.when(ok, received)).withColumn("_calc", F.when(ok, computed))
    d = d.withColumn("_addressed", ok & F.col("_kind").isin(0, 1, 2, 3, 4, 5, 6) & (F.octet_length("_payload") >= 6))
    d = d.withColumn("_adva", F.when(F.col("_addressed"), F.substr(F.col("_payload"), F.lit(1), F.lit(6))))
    rest = F.when(F.col("_addressed") & F.col("_kind").isin(0, 2, 4, 6), F.substr(F.col("_payload"), F.lit(7), F.octet_length("_payload")))
    d = d.withColumn("_ad", F.when(rest.isNotNull(), parse_ad(rest)))
    names = F.filter("_ad", lambda a: a["type"].isin(8, 9) & (F.length(a["value"]) > 0))
    first_name = F.element_at(F.filter("_ad", lambda a: a["type"].isin(8, 9)), 1)["value"]
    info = F.when(F.size("_ad") > 0, F.when((F.size(names) > 0) & (F.length(first_name) > 0), first_name).otherwise(F.element_at("_ad", 1)["name"])).when(ok & (F.col("_kind") == 7), "extended advertising header (not parsed on 1M legacy path)").when(ok, name).otherwise("")
    decoded = F.struct(
        ok.alias("ok"), F.col("_kind").alias("pdu_type"), F.when(ok, name).otherwise("").alias("pdu_name"), flag(0x40).alias("tx_add_random"), flag(0x80).alias("rx_add_random"), flag(0x20).alias("chsel"),
        F.when(~runt, length).alias("length"), F.col("_adva").alias("adva"), F.coalesce(format_address(F.col("_adva")), F.lit("")).alias("adva_str"),
        F.coalesce(F.when(F.col("_addressed"), address_kind(F.col("_adva"), flag(0x40))), F.lit("")).alias("adva_kind"),
        F.when(F.col("_addressed") & F.col("_kind").isin(1, 3, 5) & (F.octet_length("_payload") >= 12), F.substr(F.col("_payload"), F.lit(7), F.lit(6))).alias("target_a"),
        F.col("_payload").alias("payload"), F.col("_ad").alias("ad_structures"), F.col("_rx").alias("crc_received"), F.col("_calc").alias("crc_computed"), F.coalesce(F.col("_rx") == F.col("_calc"), F.lit(False)).alias("crc_ok"),
        F.when(ok, F.substr(raw, F.lit(1), length + 5)).otherwise(raw).alias("raw"), info.alias("info"),
        F.when(runt, "runt PDU").when(long, F.concat(F.lit("length field "), length.cast("string"), F.lit(" exceeds captured bytes"))).otherwise("").alias("error"),
    )
    return d.withColumn("decoded", decoded).drop("_kind", "_payload", "_rx", "_calc", "_addressed", "_adva", "_ad")


#: Bytes of a payload that are dumped as one, and lines that are put together at a time.
DUMPED_BYTES, DUMPED_LINES = 4096, 16_384


def hex_dump(df: DataFrame, data: str, key: str) -> DataFrame:
    """(key, line, text): sixteen bytes a line as offset, hex and readable characters.

    Payloads are cut into pieces first, so that no line carries its payload along, and pieces are dumped in Arrow batches.
    """
    raw = F.col(data)
    last = F.floor((F.octet_length(raw) - 1) / DUMPED_BYTES).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substr(raw, k * DUMPED_BYTES + 1, F.lit(DUMPED_BYTES)))
    d = df.where(F.octet_length(raw) > 0).select(F.col(key), F.posexplode(pieces).alias("_piece", "_data"))
    return d.mapInArrow(dumped, T.StructType([df.schema[key], T.StructField("line", T.IntegerType()), T.StructField("text", T.StringType())]))


def dumped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, piece, data) -> batches of (key, line, text), a line for each sixteen bytes of DUMPED_BYTES a piece."""
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)
    pairs = digits[np.arange(256)[:, None] >> np.array([4, 0]) & 15]
    readable = np.where((np.arange(256) >= 32) & (np.arange(256) < 127), np.arange(256), ord(".")).astype(np.uint8)
    # Columns of a line: eight digits of its offset, of which those before the last four may be left out, two blanks, the bytes, a blank, characters.
    shifts, columns = np.arange(28, -1, -4), np.arange(8 + 2 + 48 + 1 + 16)
    for b in batches:
        pieces, data = b.column(1).to_numpy(), b.column(2).cast(pa.large_binary())
        if not len(data):
            continue
        ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
        # The bytes of all pieces one after the other, and sixteen more.
        at = np.frombuffer(data.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        rows = np.lib.stride_tricks.sliding_window_view(np.append(at, np.zeros(16, np.uint8)), 16)
        starts, sizes = ends[:-1] - ends[0], np.diff(ends)
        lines = -(-sizes // 16)
        upto = np.cumsum(lines)
        for first in range(0, int(upto[-1]), DUMPED_LINES):
            n = np.arange(first, min(first + DUMPED_LINES, int(upto[-1])))
            piece = np.searchsorted(upto, n, "right")
            own = n - (upto[piece] - lines[piece])
            line, size = pieces[piece].astype(np.int64) * (DUMPED_BYTES // 16) + own, np.minimum(sizes[piece] - 16 * own, 16)
            x = rows[starts[piece] + 16 * own]
            out = np.full((len(n), len(columns)), ord(" "), np.uint8)
            out[:, :8] = digits[(16 * line)[:, None] >> shifts & 15]
            out[:, 10:58].reshape(len(n), 16, 3)[:, :, :2] = pairs[x]
            out[:, 59:] = readable[x]
            short = np.flatnonzero(size < 16)
            out[short, 10:58] = np.where(np.repeat(np.arange(16) < size[short, None], 3, 1), out[short, 10:58], ord(" "))
            begin, end = 4 - np.sum(line[:, None] >= 1 << np.array([12, 16, 20, 24]), 1), 59 + size
            text = out[(columns >= begin[:, None]) & (columns < end[:, None])]
            places = np.append(0, np.cumsum(end - begin)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(piece)), pa.array(line.astype(np.int32)), pa.StringArray.from_buffers(len(n), pa.py_buffer(places), pa.py_buffer(text))], [b.schema.names[0], "line", "text"])


def bit_differences(a: Column, b: Column) -> Column:
    """Places, from 0, at which two arrays of bits of the shorter one's length differ."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, i) != F.get(b, i))).otherwise(F.array().cast("array<int>"))
