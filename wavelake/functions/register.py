"""The byte and scalar functions under names that SQL can call."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..constants import ADVERTISING_CRC_INIT
from ..dims import keystream
from . import bytes as B


@udtf(returnType=T.StructType([T.StructField("place", T.IntegerType()), *B.AD_ITEM.fields]))
class AdItems:
    """Table function: a row for each item of advertising data."""

    def eval(self, payload: bytes):
        for k, item in enumerate(B.ad_items(payload) or []):
            yield (k, *item)


#: Bytes by which all payloads go on together; longer ones are cut into stretches of so many.
STRETCH = 256


@lru_cache(1)
def _after_stretch() -> np.ndarray:
    """What STRETCH zero bytes make of a check, by each of its three bytes: [place, byte]."""
    table = np.array(B._crc_table(), np.int64)
    state = np.arange(256, dtype=np.int64)[None, :] << np.array([[0], [8], [16]])
    for _ in range(STRETCH):
        state = state >> 8 ^ table[state & 255]
    return state


def _crc(data: list[bytes], init: int = ADVERTISING_CRC_INIT) -> np.ndarray:
    """Checks of some byte strings, in numpy steps whose number doesn't follow the longest one's bytes.

    A payload is cut, from its end, into stretches: a first one of up to STRETCH bytes that begins
    with init, and whole ones that begin with zero. All stretches go on by a byte at a time, the
    longest first; a check is linear, so each stretch's is added to what it makes of the one before.
    """
    table = np.array(B._crc_table(), np.int64)
    sizes = np.array([len(x) for x in data], np.int64)
    count = np.maximum(-(-sizes // STRETCH), 1)
    place = np.cumsum(count) - count
    length = np.full(int(count.sum()), STRETCH, np.int64)
    length[place] = sizes - (count - 1) * STRETCH
    start = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    flat, first = np.frombuffer(b"".join(data), np.uint8), start[order]
    left = np.searchsorted(-length[order], -np.arange(1, length.max(initial=0) + 1), "right")
    own = np.zeros(len(length), np.int64)
    own[place] = B.reflect24(init)
    state = own[order]
    for k, n in enumerate(left.tolist()):
        state[:n] = state[:n] >> 8 ^ table[(state[:n] ^ flat[first[:n] + k]) & 255]
    own[order] = state
    # Payloads of many stretches go on together, too.
    after, out = _after_stretch(), own[place].copy()
    order = np.argsort(-count, kind="stable")
    left = np.searchsorted(-count[order], -np.arange(2, count.max(initial=1) + 1), "right")
    for k, n in enumerate(left.tolist(), 1):
        i = order[:n]
        c = out[i]
        out[i] = after[0, c & 255] ^ after[1, c >> 8 & 255] ^ after[2, c >> 16] ^ own[place[i] + k]
    return out


@F.pandas_udf(T.LongType())
def crc24(data: pd.Series) -> pd.Series:
    known = data.notna().to_numpy()
    if known.all():
        return pd.Series(_crc(data.tolist()))
    out = pd.Series([None] * len(data), dtype="Int64")
    out[known] = _crc(data[known].tolist())
    return out


@lru_cache(1)
def _streams() -> np.ndarray:
    """The keystream of each of the 40 channels."""
    return np.stack([np.frombuffer(keystream(c, B.PERIOD), np.uint8) for c in range(40)])


@F.pandas_udf(T.BinaryType())
def dewhiten(data: pd.Series, channel: pd.Series) -> pd.Series:
    known = (data.notna() & channel.notna()).to_numpy()
    raw = data[known].tolist()
    sizes = np.array([len(x) for x in raw], np.int64)
    end = np.cumsum(sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(end - sizes, sizes)
    flat = np.frombuffer(b"".join(raw), np.uint8) ^ _streams()[np.repeat(channel[known].to_numpy(np.int64), sizes), place % B.PERIOD]
    whole, out = flat.tobytes(), np.full(len(data), None, object)
    out[known] = [whole[i:j] for i, j in zip((end - sizes).tolist(), end.tolist(), strict=True)] or None
    return pd.Series(out)


SQL_FUNCTIONS = {
    "channel_to_freq(channel INT) RETURNS DOUBLE": "CASE WHEN channel = 37 THEN 2402 WHEN channel = 38 THEN 2426 WHEN channel = 39 THEN 2480 WHEN channel BETWEEN 0 AND 10 THEN 2404 + 2 * channel WHEN channel BETWEEN 11 AND 36 THEN 2406 + 2 * channel ELSE raise_error(concat('no channel ', channel)) END * 1e6D",
    "is_advertising(channel INT) RETURNS BOOLEAN": "channel IN (37, 38, 39)",
    "format_address(address BINARY) RETURNS STRING": "CASE WHEN octet_length(address) = 6 THEN concat_ws(':', substr(hex(address), 11, 2), substr(hex(address), 9, 2), substr(hex(address), 7, 2), substr(hex(address), 5, 2), substr(hex(address), 3, 2), substr(hex(address), 1, 2)) END",
    "power_db(power DOUBLE) RETURNS DOUBLE": "10 * log10(greatest(power, 1e-15D))",
    "floor_bin(x DOUBLE, width DOUBLE) RETURNS DOUBLE": "floor(x / width) * width",
    "finite(x DOUBLE) RETURNS DOUBLE": "CASE WHEN NOT isnan(x) AND abs(x) <> double('Infinity') THEN x END",
}


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to a session's SQL; their names."""
    spark.udf.register("crc24", crc24)
    spark.udf.register("dewhiten", dewhiten)
    spark.udf.register("parse_ad", B.parse_ad)
    spark.udtf.register("ad_items", AdItems)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return ["crc24", "dewhiten", "parse_ad", "ad_items", *(h.split("(")[0] for h in SQL_FUNCTIONS)]
