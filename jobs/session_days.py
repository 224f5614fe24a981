"""Strength of each address by day and channel, and how it differs between channels.

Packets of one day are one session, as if each day had been recorded to a file of its own. A display
filter may select packets. Two outputs, by day: `strengths` (mean, spread and count by address and
channel) and `differences` (of mean strength between each two channels on which an address was
heard, which hold for transmitters that stood still). Days that a run covers are replaced, so that it
may be run again or for some days only; values are rounded, so that they don't depend on the order of sums.

    python -m jobs.session_days --config jobs/session_days.json --set events=/data/events.parquet --set out=/data/days
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, overwrite
from wavelake import adapters
from wavelake.operators.joins import channel_differences, session_strengths
from wavelake.plans.filters import filtered

STRENGTHS = "adva string, channel int, mean double, std double, n long, day date"
DIFFERENCES = "adva string, channel_a int, channel_b int, difference_db double, n_a long, n_b long, day date"


def run(spark: SparkSession, config: dict) -> DataFrame:
    """config: events, out; optionally filter, first_day, last_day (inclusive), digits. The differences of the days, read back."""
    out, digits = config["out"].rstrip("/"), config.get("digits", 6)
    events = spark.read.parquet(config["events"])
    span = F.lit(True)
    if config.get("first_day"):  # on the column as it is stored, so that the scan can leave row groups out
        span = span & (F.col("ts") >= F.to_timestamp_ntz(F.lit(config["first_day"])))
    if config.get("last_day"):
        span = span & (F.col("ts") < F.date_add(F.to_date(F.lit(config["last_day"])), 1).cast("timestamp_ntz"))
    events = events.where(span)
    log.info("read %d events of %s", events.count(), config["events"])
    packets = filtered(adapters.packets(events), config.get("filter", ""))
    strengths = session_strengths(packets.withColumn("day", F.to_date("event_time")), ["day"])
    strengths = strengths.select("adva", "channel", *[F.round(c, digits).alias(c) for c in ("mean", "std")], "n", "day")
    for name, schema in (("strengths", STRENGTHS), ("differences", DIFFERENCES)):  # no rows: the folder is there, whatever is read
        spark.createDataFrame([], schema).write.mode("append").partitionBy("day").parquet(f"{out}/{name}")
    overwrite(strengths, f"{out}/strengths", "day")
    # The aggregate is small: the second output is made of the first one's files, packets are read once.
    done = spark.read.schema(STRENGTHS).parquet(f"{out}/strengths")
    days = F.lit(True)
    if config.get("first_day"):
        days = days & (F.col("day") >= F.lit(config["first_day"]).cast("date"))
    if config.get("last_day"):
        days = days & (F.col("day") <= F.lit(config["last_day"]).cast("date"))
    differences = channel_differences(done.where(days), ["day"]).withColumn("difference_db", F.round("difference_db", digits))
    overwrite(differences.select("adva", "channel_a", "channel_b", "difference_db", "n_a", "n_b", "day"), f"{out}/differences", "day")
    written = spark.read.schema(DIFFERENCES).parquet(f"{out}/differences").where(days)
    log.info("wrote %d strengths and %d differences to %s", done.where(days).count(), written.count(), out)
    return written


if __name__ == "__main__":
    raise SystemExit(main(__doc__, run))
