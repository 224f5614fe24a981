"""What a stream does when it falls behind: costly figures are shed first, and each loss is counted apart.

Spark drops nothing: when a query falls behind, its triggers grow. Within a trigger, rows of a block that
has many newer blocks of its session behind it get the cheap figures only, the latest ones all; which is
which follows from the trigger's rows alone. Counters are written with each trigger's rows, in a
partition of the trigger, so one that is repeated after a failure replaces its own.

    lapped         blocks that were overwritten before they were read
    empty          blocks that were read but hold no samples
    missing        samples missing between blocks, by their clocks
    shed           rows of which only the cheap figures were taken
    failed_checks  packets whose check is wrong
    beyond_table   packets that a table of the latest rows no longer shows
"""

from __future__ import annotations

import logging
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import constants as C
from ..operators.windows import lost_samples

LOG = logging.getLogger("wavelake.pressure")
COUNTERS = "session string, counter string, n long"


def with_backlog(rows: DataFrame, capacity: float, limit: float = 0.5, by: list[str] = ("session",), place: str = "block_index") -> DataFrame:
    """rows with `backlog`, the blocks behind each in its session as a share of capacity, and `full`, whether that is below the limit.

    The newest block is one row a session. Rows without a place have no backlog and are full.
    """
    newest = rows.groupBy(*by).agg(F.max(place).alias("_newest"))
    same = F.lit(True)
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_n_{k}"))
    d = rows.join(newest.withColumnsRenamed({k: f"_n_{k}" for k in by}), same, "left")
    d = d.select(*rows.columns, F.coalesce((F.col("_newest") - F.col(place)) / F.lit(float(max(capacity, 1))), F.lit(0.0)).alias("backlog"))
    return d.withColumn("full", F.col("backlog") < limit)


def _long(d: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """COUNTERS of some rows, zeros included: one aggregate by session, then a row for each counter."""
    a = d.groupBy("session").agg(*[c.cast("long").alias(k) for k, c in counts.items()])
    return a.select("session", F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.coalesce(k, F.lit(0).cast("long")).alias("n")) for k in counts])).alias("_c")).select("session", "_c.counter", "_c.n")


def block_counters(blocks: DataFrame) -> DataFrame:
    """COUNTERS of blocks: blocks, lapped, empty and missing.

    Blocks need `lapped`, and may tell by `timestamp_valid` whether their clock counts. Samples of blocks
    that are lapped or empty are not missing once more: gaps beside these are left out.
    """
    lapped, empty = F.coalesce("lapped", F.lit(False)), F.coalesce("n_samples", F.lit(0)) == 0
    clock = F.coalesce("timestamp_valid", F.lit(False)) if "timestamp_valid" in blocks.columns else F.lit(True)
    d = lost_samples(blocks.withColumn("timestamp_valid", clock & ~lapped & ~empty), ["session"])
    return _long(d, {"blocks": F.count("*"), "lapped": F.count_if(lapped), "empty": F.count_if(~lapped & empty), "missing": F.sum("lost")})


def packet_counters(packets: DataFrame) -> DataFrame:
    """COUNTERS of packets: packets, shed and failed_checks."""
    return _long(packets, {"packets": F.count("*"), "shed": F.count_if(~F.coalesce("features_full", F.lit(True))), "failed_checks": F.count_if(~F.coalesce("crc_ok", F.lit(False)))})


class Pace:
    """How many blocks a trigger can bear: so many seconds' worth at the median rate of the last triggers."""

    def __init__(self, seconds: float, first: float, triggers: int = 9):
        self.seconds, self.first, self.rates = seconds, first, deque(maxlen=triggers)

    def saw(self, blocks: int, seconds: float) -> None:
        if blocks:
            self.rates.append(blocks / max(seconds, 1e-3))

    def capacity(self) -> float:
        return sorted(self.rates)[len(self.rates) // 2] * self.seconds if self.rates else self.first


def shedding(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, mark: str, capacity: float | Pace, limit: float = 0.5) -> DataStreamWriter:
    """A writer of work's packets under out/packets and their counters under out/counters, by trigger; start() it.

    stream: rows with session and block_index, such as detections. work gets a trigger's rows with `full`,
    and returns packets with session, features_full and crc_ok, such as measure(full="full") joined to the
    parsed packets. With a number as capacity a trigger's rows decide alone; with a Pace, capacity follows
    the rate at which triggers were worked off, as their own observed counts tell.
    """

    def trigger(rows: DataFrame, number: int) -> None:
        began, bears = time.monotonic(), capacity.capacity() if isinstance(capacity, Pace) else capacity
        seen = Observation()
        marked = with_backlog(rows, bears, limit).observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("full")).alias("shed"), F.approx_count_distinct(F.struct("session", "block_index")).alias("blocks"))
        # Overwriting the trigger's own folders makes a repeat of it harmless.
        at = f"{out}/packets/trigger={number}"
        packets = work(marked)
        packets.write.mode("overwrite").parquet(at)
        spark = rows.sparkSession
        packet_counters(spark.read.schema(packets.schema).parquet(at)).coalesce(1).write.mode("overwrite").parquet(f"{out}/counters/trigger={number}")
        figures, took = seen.get, time.monotonic() - began
        if isinstance(capacity, Pace):
            capacity.saw(figures["blocks"], took)
        LOG.info("trigger %d: %s in %.1f s, capacity %.0f blocks", number, figures, took, bears)

    return stream.writeStream.foreachBatch(trigger).option("checkpointLocation", mark)


def counting(blocks: DataFrame, out: str, mark: str) -> DataStreamWriter:
    """A writer of block_counters() by trigger under out; clocks are compared within a trigger's blocks."""

    def trigger(rows: DataFrame, number: int) -> None:
        block_counters(rows).coalesce(1).write.mode("overwrite").parquet(f"{out}/trigger={number}")

    return blocks.writeStream.foreachBatch(trigger).option("checkpointLocation", mark)


def totals(counters: DataFrame, rows: int = C.TABLE_ROWS) -> DataFrame:
    """COUNTERS of all triggers, and `beyond_table`: packets that a table of so many latest rows of a session no longer shows."""
    d = counters.groupBy("session", "counter").agg(F.sum("n").alias("n"))
    beyond = d.where("counter = 'packets'").select("session", F.lit("beyond_table").alias("counter"), F.greatest(F.col("n") - rows, F.lit(0)).cast("long").alias("n"))
    return d.unionByName(beyond)
