"""Views of general event, vector and text tables as packet data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first instant of the packet clock, in microseconds, and how much faster it runs.
ORIGIN_US, SPEED = 1_704_067_200_000_000, 10_000.0
#: Packet types that event types stand for.
TYPES = {"view": "ADV_IND", "click": "ADV_NONCONN_IND", "error": "SCAN_REQ", "purchase": "SCAN_RSP", "signup": "ADV_SCAN_IND"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packets(events: DataFrame) -> DataFrame:
    """Packet rows from (event_id, ts, user_id, event_type, value)."""
    e, n = F.col, F.col("event_id")
    us = F.unix_micros(e("ts").cast("timestamp"))
    name = F.lit("ADV_DIRECT_IND")
    for k, v in TYPES.items():
        name = F.when(e("event_type") == k, v).otherwise(name)
    byte = lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")
    return events.select(
        n.alias("number"), F.lit(False).alias("is_event"), F.lit(None).cast("string").alias("event_kind"), F.lit(None).cast("string").alias("event_text"),
        ((us - ORIGIN_US) / SPEED).alias("timestamp_us"), (us / 1e6).alias("wall_time"), e("ts").cast("timestamp").alias("event_time"),
        (37 + n % 3).cast("int").alias("channel"), name.alias("pdu_name"),
        F.concat(F.lit("C0:DE:00:00:"), byte(F.floor(e("user_id") / 256) % 256), F.lit(":"), byte(e("user_id") % 256)).alias("adva"),
        F.when(e("user_id") % 4 == 0, "public").otherwise("random static").alias("adva_kind"), (e("user_id") % 4 != 0).alias("tx_add_random"),
        (n % 32).cast("int").alias("length"), (n % 7 != 0).alias("crc_ok"), F.when(n % 11 != 0, -90 + e("value") / 7).alias("rssi_dbfs"),
        (20 + (n % 90) / 10).alias("temperature_c"), F.when(n % 5 != 0, (n % 37 - 18) * 10.0).alias("aoa_deg"), F.when(n % 13 != 0, e("value") / 7 - n % 29).alias("cfo_ppm"),
        e("props").alias("info"), F.when(n % 17 == 0, F.array(F.lit("burst"))).when(n % 19 == 0, F.array(F.lit("drift"), F.lit("two separated feature clusters"))).otherwise(F.array().cast("array<string>")).alias("alerts"),
        (F.abs(e("value")) / 100).alias("anomaly_score"), (n % 3 == 0).alias("calibrated"),
    )


def vectors(embeddings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(adva, number, one column for each key) from (vec_id, embedding, label)."""
    return embeddings.select(F.col("label").cast("string").alias("adva"), F.col("vec_id").alias("number"), *[F.get("embedding", F.lit(i)).cast("double").alias(k) for i, k in enumerate(keys)])


#: Bytes that the longest text has at most.
WHOLE = 1 << 30


def payloads(documents: DataFrame, n: int = WHOLE) -> DataFrame:
    """(doc_id, data): each text's bytes, the first n of them, as payloads."""
    return documents.select("doc_id", F.substr(F.col("text").cast("binary"), F.lit(1), F.lit(n)).alias("data"))


def pieces(documents: DataFrame, n: int = 32) -> DataFrame:
    """(doc_id, part, data): all of each text's bytes as payloads of n, the last one of what is left; one without bytes has an empty one."""
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    last = F.greatest(F.floor((F.octet_length(raw) - 1) / n), F.lit(0)).cast("int")
    # Pieces are exploded themselves, so that no row carries its whole text along.
    d = documents.select("doc_id", raw.alias("_raw"), last.alias("_last"))
    each = F.transform(F.sequence(F.lit(0), F.col("_last")), lambda k: F.substr(F.col("_raw"), k * n + 1, F.lit(n)))
    return d.select("doc_id", F.posexplode(each).alias("part", "data"))
