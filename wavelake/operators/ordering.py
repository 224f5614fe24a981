"""Top rows, unions, removal of repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .stats import latest


def busiest(df: DataFrame, n: int = C.DRAWN, focus: str | None = None) -> DataFrame:
    """(adva, packets) of the n addresses with most rows (first seen first among equals); with a known focus, that one alone."""
    counts = df.groupBy("adva").agg(F.count("*").alias("packets"), F.min("number").alias("first"))
    if focus is not None:
        known = counts.agg(F.coalesce(F.max(F.col("adva") == focus), F.lit(False)).alias("_focus"))  # one row
        counts = counts.join(F.broadcast(known)).where((F.col("adva") == focus) | ~F.col("_focus")).drop("_focus")
    return counts.orderBy(F.desc("packets"), "first").limit(n).select("adva", "packets")


def series(df: DataFrame, value: str, n: int = C.DRAWN, rows: int = C.SERIES_ROWS, tracked: int = C.TRACKED, focus: str | None = None) -> DataFrame:
    """(adva, number, time_s, value): the last finite values of the busiest addresses among those tracked."""
    from ..functions.scalars import finite

    d = df.withColumn("value", finite(F.col(value))).where("value is not null")
    drawn = busiest(d.join(F.broadcast(busiest(d, tracked).select("adva")), "adva", "left_semi"), n, focus).select("adva")
    d = d.join(F.broadcast(drawn), "adva", "left_semi").select("adva", "number", (F.col("timestamp_us") / 1e6).alias("time_s"), "value")
    return latest(d, ["adva"], "number", rows)


def retained(df: DataFrame, rows: int = C.TABLE_ROWS) -> DataFrame:
    """The last rows by number: a top-k, not a sort of all."""
    return df.orderBy(F.desc("number")).limit(rows)


def worst(contributions: str = "anomaly_contributions", n: int = 3):
    """The n entries of a map of deviations that are largest by size, as an array of (key, value)."""
    entries = F.array_sort(F.map_entries(F.col(contributions)), lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1).when(F.abs(a["value"]) < F.abs(b["value"]), 1).when(a["key"] < b["key"], -1).otherwise(1))
    return F.slice(entries, 1, n)


def with_events(packets: DataFrame, *events: DataFrame) -> DataFrame:
    """Packets with a row for each of their alerts, and other event rows, in one table.

    Event rows keep their packet's number; (number, is_event, ordinal) is a key.
    """
    alerts = packets.select("*", F.posexplode("alerts").alias("_i", "_text"))
    alerts = alerts.withColumn("is_event", F.lit(True)).withColumn("event_kind", F.lit("alert")).withColumn("event_text", F.col("_text")).withColumn("ordinal", F.col("_i") + 1).withColumn("alerts", F.array().cast("array<string>")).withColumn("crc_ok", F.lit(False)).drop("_i", "_text")
    first = packets.withColumn("ordinal", F.lit(0))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (alerts, *events), first)


def once(detections: DataFrame, keys: list[str], sync: str = "abs_sync") -> DataFrame:
    """Detections without repeats of a sync position, which overlapping blocks both find."""
    return detections.dropDuplicates([*keys, sync])
