"""Sources: sessions, sample blocks, calibration history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dsp.synth import BLOCKS
from ..functions.scalars import all_finite, finite


def sample_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Sample blocks; files laid out by session/epoch/channel prune on these."""
    return spark.read.schema(BLOCKS).parquet(path)


def block_at(blocks: DataFrame, index: int) -> DataFrame:
    return blocks.where((F.col("block_index") == index) & (F.octet_length("iq") == 4 * F.col("n_samples") * F.col("n_channels")))


def sample_range(blocks: DataFrame, start: int, count: int) -> DataFrame:
    """(session, epoch, start, iq): the samples [start, start + count) where the blocks hold all of them.

    Only blocks that meet the range are read; a range of one capture is bounded by `count`.
    """
    end, width = start + count, 4 * F.col("n_channels")
    part = blocks.where((F.col("first_sample") < end) & (F.col("first_sample") + F.col("n_samples") > start))
    a = F.greatest(F.lit(start) - F.col("first_sample"), F.lit(0))
    z = F.least(F.lit(end) - F.col("first_sample"), F.col("n_samples").cast("long"))
    piece = F.substr(F.col("iq"), (a * width + 1).cast("int"), ((z - a) * width).cast("int"))
    d = part.select("session", "epoch", (F.col("first_sample") + a).alias("at"), (z - a).alias("n"), piece.alias("piece"))
    d = d.groupBy("session", "epoch").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    whole = d.where(F.col("n") == count)
    return whole.select("session", "epoch", F.lit(start).alias("start"), F.unhex(F.array_join(F.transform("pieces", lambda p: F.hex(p["piece"])), "")).alias("iq"))


def parquet_sessions(spark: SparkSession, *paths: str) -> DataFrame:
    """Exported packet rows of any mix of columns; missing ones are null, not-a-numbers too."""
    return all_finite(spark.read.option("mergeSchema", "true").parquet(*paths))


def csv_sessions(spark: SparkSession, *paths: str) -> DataFrame:
    """Exported packet rows from CSV: text, but for the check (true or 1) and the strength (a number or null)."""
    d = spark.read.option("header", "true").csv(list(paths))
    return d.withColumn("crc_ok", F.lower(F.trim("crc_ok")).isin("true", "1")).withColumn("rssi_dbfs", finite(F.expr("try_cast(rssi_dbfs as double)")))


def session_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files as sessions: each takes the channel of its first row (-1 without any) for all of them."""
    out = None
    for path in paths:
        d = csv_sessions(spark, path) if path.endswith(".csv") else parquet_sessions(spark, path)
        first = d.select("channel").first() if "channel" in d.columns else None
        d = d.select("adva", "crc_ok", "rssi_dbfs").withColumn("channel", F.lit(int(first[0]) if first is not None and first[0] is not None else -1)).withColumn("path", F.lit(path))
        out = d if out is None else out.unionByName(d)
    return out


def calibration_history(spark: SparkSession, path: str) -> DataFrame:
    """Calibration rows from JSON; a missing file or one that is no JSON has none."""
    from pyspark.errors import AnalysisException

    schema = "ts double, source string, channel int, gain_db int, samples long, dc_i double, dc_q double, dc_magnitude_dbfs double, gain_imbalance double, quadrature_skew_deg double, image_rejection_db double, noise_floor_dbfs double, rms_dbfs double, peak_dbfs double, clipping boolean, antenna_phase_offset_deg double, antenna_phase_spread_deg double, antenna_coherence double, antenna_packets int, notes array<string>, ok boolean"
    try:
        d = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return d.where("ts is not null")
