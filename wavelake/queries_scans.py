"""Named queries over keys that hold a third of all rows each: ordered operators in ranges of the order, and spans of any length."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import adapters as A
from .operators import joins, windows
from .queries import _packets, _r, query
from .streaming import pressure
from .tables import shared_folder

#: Numbers of packets in a range of the order; a channel has a third of all packets.
_RANGE = 2_000


@query("SELECT number, channel, sum(leap) OVER (PARTITION BY channel ORDER BY number ROWS UNBOUNDED PRECEDING)::BIGINT AS segment FROM (SELECT *, CASE WHEN timestamp_us / 1e6 - lag(timestamp_us / 1e6) OVER (PARTITION BY channel ORDER BY number) > 60 THEN 1 ELSE 0 END AS leap FROM packets)")
def channel_segments(spark, sf_dir):
    """A channel's packets in pieces, parted where time leaps by a minute."""
    d = _packets(spark, sf_dir).withColumn("time_s", F.col("timestamp_us") / 1e6)
    return windows.gap_segments(d, ["channel"], "time_s", "number", 60.0, size=_RANGE).select("number", F.col("channel").cast("long"), "segment")


@query("SELECT number, channel, round(rssi_dbfs, 6) AS rssi_dbfs, b IS NULL OR abs(rssi_dbfs - b) > 20 AS moved, coalesce(e <> number // 500, FALSE) AS new_epoch FROM (SELECT *, lag(rssi_dbfs) OVER w AS b, lag(number // 500) OVER w AS e FROM packets WHERE rssi_dbfs IS NOT NULL WINDOW w AS (PARTITION BY channel ORDER BY number)) WHERE b IS NULL OR abs(rssi_dbfs - b) > 20 OR coalesce(e <> number // 500, FALSE)")
def channel_changes(spark, sf_dir):
    """Packets at which a channel's strength moves by over 20 dB, or an epoch of 500 packets begins."""
    d = _packets(spark, sf_dir).withColumn("epoch", F.floor(F.col("number") / 500))
    d = windows.change_points(d, ["channel"], "number", "rssi_dbfs", 20.0, epoch="epoch", size=_RANGE)
    return d.select("number", F.col("channel").cast("long"), *_r("rssi_dbfs"), "moved", "new_epoch")


@query("SELECT number, channel, round(max(rssi_dbfs + 0.35 * i) OVER (PARTITION BY channel ORDER BY number ROWS UNBOUNDED PRECEDING) - 0.35 * i, 5) AS peak FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY number) AS i FROM good WHERE rssi_dbfs IS NOT NULL)")
def channel_peaks(spark, sf_dir):
    """A channel's strongest packet so far, falling with each packet."""
    d = _packets(spark, sf_dir).where("crc_ok and rssi_dbfs is not null")
    return windows.peak_hold(d, "channel", "number", "rssi_dbfs", size=_RANGE).select("number", F.col("channel").cast("long"), *_r("peak", digits=5))


@query("SELECT number, channel, round(list_reduce(list(rssi_dbfs) OVER (PARTITION BY channel ORDER BY number ROWS 799 PRECEDING), lambda a, x: 0.95 * a + 0.05 * x), 5) AS follower FROM good WHERE rssi_dbfs IS NOT NULL")
def channel_followers(spark, sf_dir):
    """A channel's strength, followed by a twentieth of each good packet; SQL goes back 799 packets, whose weight is 1e-18."""
    d = _packets(spark, sf_dir).where("crc_ok and rssi_dbfs is not null")
    return windows.followed(d, {"follower": F.col("rssi_dbfs")}, "number", ["channel"], 0.95, size=_RANGE).select("number", F.col("channel").cast("long"), *_r("follower", digits=5))


_AIR = ", a AS (SELECT channel, floor(timestamp_us)::BIGINT AS s, floor(timestamp_us)::BIGINT + length * 2000 AS e FROM packets), n AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY channel ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM a), g AS (SELECT *, sum(fresh) OVER (PARTITION BY channel ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS piece FROM n) "


@query(_AIR + "SELECT channel, min(s) AS start, max(e) AS \"end\" FROM g GROUP BY channel, piece")
def airtime(spark, sf_dir):
    """When each channel is busy: packets' spans, those that touch or overlap made one."""
    s = F.floor("timestamp_us")
    d = _packets(spark, sf_dir).select(F.col("channel").cast("long"), s.alias("start"), (s + F.col("length") * 2_000).cast("long").alias("end"))
    return windows.merged_spans(d, ["channel"], "start", "end", size=10_000_000).select("channel", "start", "end")


@query(", q AS (SELECT number, adva, floor(timestamp_us)::BIGINT AS s, floor(lead(timestamp_us) OVER (PARTITION BY adva ORDER BY timestamp_us, number))::BIGINT AS e FROM packets), b AS (SELECT number, adva, floor(timestamp_us)::BIGINT AS s, floor(timestamp_us)::BIGINT + 2000000 AS e FROM packets WHERE NOT crc_ok) SELECT q.number AS quiet, b.number AS bad, q.adva FROM q JOIN b ON q.adva = b.adva WHERE q.e > q.s AND q.s < b.e AND b.s < q.e")
def quiet_spans(spark, sf_dir):
    """Spans between an address's packets, thousands of buckets long, that bad packets' two seconds overlap."""
    p = _packets(spark, sf_dir)
    s = F.floor("timestamp_us")
    ahead = F.floor(F.lead("timestamp_us").over(Window.partitionBy("adva").orderBy("timestamp_us", "number")))
    quiet = p.select("number", "adva", s.alias("start"), ahead.alias("end"))
    bad = p.where("not crc_ok").select("number", "adva", s.alias("start"), (s + 2_000_000).alias("end"))
    return joins.overlapping(quiet, bad, ["adva"], 1_000).select(F.col("number_a").alias("quiet"), F.col("number_b").alias("bad"), "adva")


# -- streams that fall behind --------------------------------------------------------------------

_BLOCKS = "WITH b AS (SELECT (event_id % 3)::VARCHAR AS session, event_id AS block_index, event_id * 1000 + event_id % 7 * 5 AS first_sample, CASE WHEN event_id % 29 = 0 THEN 0 ELSE 3000 - event_id % 4 END AS n_samples, event_id % 23 = 0 AS lapped, event_id % 31 <> 0 AS valid, event_id % 7 <> 0 AS crc_ok FROM events) "
#: Blocks that a trigger can bear, of which half may wait.
_BEARS = 400


def _clocked(d):
    """Blocks' clocks made from events, in three sessions; some are lapped, some are empty, some clocks don't count."""
    n = F.col("event_id")
    short = F.when(n % 29 == 0, 0).otherwise(3000 - n % 4)
    return d.select((n % 3).cast("string").alias("session"), n.alias("block_index"), (n * 1000 + n % 7 * 5).alias("first_sample"), short.alias("n_samples"), (n % 23 == 0).alias("lapped"), (n % 31 != 0).alias("timestamp_valid"), (n % 7 != 0).alias("crc_ok"))


@query(
    _BLOCKS + ", g AS (SELECT *, first_sample - lag(first_sample + n_samples) OVER w AS gap, valid AND NOT lapped AND n_samples > 0 AS ok, lag(valid AND NOT lapped AND n_samples > 0) OVER w AS was FROM b WINDOW w AS (PARTITION BY session ORDER BY block_index)), t AS (SELECT session, count(*) AS blocks, count(*) FILTER (lapped) AS lapped, count(*) FILTER (NOT lapped AND n_samples = 0) AS empty, coalesce(sum(gap) FILTER (ok AND was AND gap > 0), 0) AS missing FROM g GROUP BY session) SELECT session, unnest(['blocks', 'lapped', 'empty', 'missing']) AS counter, unnest([blocks, lapped, empty, missing])::BIGINT AS n FROM t",
    "",
)
def block_losses(spark, sf_dir):
    """Lapped and empty blocks and missing samples of each session, counted apart."""
    return pressure.block_counters(_clocked(A.table(spark, sf_dir, "events")))


@query(
    _BLOCKS + f", m AS (SELECT *, (max(block_index) OVER (PARTITION BY session) - block_index) / {_BEARS}.0 < 0.5 AS whole FROM b), t AS (SELECT session, count(*) AS packets, count(*) FILTER (NOT whole) AS shed, count(*) FILTER (NOT crc_ok) AS failed_checks, greatest(count(*) - 1000, 0) AS beyond_table FROM m GROUP BY session) SELECT session, unnest(['packets', 'shed', 'failed_checks', 'beyond_table']) AS counter, unnest([packets, shed, failed_checks, beyond_table])::BIGINT AS n FROM t",
    "",
)
def shed_stream(spark, sf_dir):
    """What one trigger over all events sheds, as a file stream writes and counts it."""
    at = shared_folder(spark)
    # As a pattern, so that a single file is as good as a folder of files.
    path = f"{sf_dir.rstrip('/')}/events.parque[t]"
    events = spark.readStream.schema(A.table(spark, sf_dir, "events").schema).parquet(path)
    writer = pressure.shedding(_clocked(events), lambda d: d.withColumnRenamed("full", "features_full"), f"{at}/out", f"{at}/mark", _BEARS)
    writer.trigger(availableNow=True).start().awaitTermination()
    return pressure.totals(spark.read.schema(pressure.COUNTERS).parquet(f"{at}/out/counters"), rows=1000)
