"""Joins: sessions by address, as-of, intervals, baselines, nearest channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dims import channels
from ..functions.scalars import finite

WARNING = "channels were not captured simultaneously: differences of strength hold only for transmitters and surroundings that stood still"


def session_strengths(sessions: DataFrame, by: list[str] = ()) -> DataFrame:
    """(*by, adva, channel, mean, std, n) of good packets' strengths; sessions of one channel are pooled, std is of the population."""
    r = finite(F.col("rssi_dbfs"))
    d = sessions.where((F.coalesce(F.col("adva"), F.lit("")) != "") & F.col("crc_ok") & r.isNotNull())
    return d.groupBy(*by, "adva", "channel").agg(F.avg(r).alias("mean"), F.stddev_pop(r).alias("std"), F.count("*").alias("n"))


def channel_differences(strengths: DataFrame, by: list[str] = ()) -> DataFrame:
    """Differences of mean strength between each two channels of session_strengths() on which an address was heard.

    The join is on the aggregate, a row for each address and channel (40 at most), so an address
    yields 780 pairs at most.
    """
    a, b = (strengths.select(*by, "adva", *[F.col(c).alias(f"{c}_{side}") for c in ("channel", "mean", "n")]) for side in "ab")
    pairs = a.join(b, [*by, "adva"]).where("channel_a < channel_b")
    return pairs.select(*by, "adva", "channel_a", "channel_b", (F.col("mean_a") - F.col("mean_b")).alias("difference_db"), "n_a", "n_b")


def session_join(sessions: DataFrame) -> DataFrame:
    """Differences of mean strength between each two channels on which an address was heard."""
    return channel_differences(session_strengths(sessions))


def session_report(sessions: DataFrame) -> DataFrame:
    """One JSON-able row for each address heard on two or more channels, in order of address."""
    s = session_strengths(sessions)
    per = s.groupBy("adva").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("channel").cast("string"), F.struct("mean", "std", "n"))))).alias("channels"), F.count("*").alias("_n")).where("_n >= 2").drop("_n")
    pairs = session_join(sessions).groupBy("adva").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws("-", "channel_a", "channel_b"), "difference_db")))).alias("differences_db"))
    return per.join(pairs, "adva").withColumn("warning", F.lit(WARNING)).orderBy("adva")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str, to: str, span: float | None = None) -> DataFrame:
    """left with the value of right's latest row at or before its time, by union and windows.

    Rows of both sides share one sort by key and time, so no pairs are formed, whatever the counts.
    With a span of time, the sort is within a key's stretches of that length, and what a stretch
    begins with comes from the last row of those before (a row for each): a hot key is many tasks' work.
    """
    columns = left.columns
    l = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_side", F.lit(1))  # noqa: E741
    r = right.select(*keys, F.col(time), F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True)
    if span is None:
        w = Window.partitionBy(*keys).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
        return both.withColumn(to, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select(*columns, to)
    both = both.withColumn("_stretch", F.floor(F.col(time) / span))
    spans = both.groupBy(*keys, F.col("_stretch").alias("_at")).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(time))).alias("_end"))
    w = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_at", F.last("_end", ignorenulls=True).over(w).alias("_before"))
    w = Window.partitionBy(*keys, "_stretch").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_own", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    same = F.col("_stretch").eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return both.join(spans, same, "left").select(*columns, F.coalesce("_own", "_before").alias(to))


def reaction_latency(onsets: DataFrame, preambles: DataFrame, keys: list[str], time: str = "time_us", last: int = 64, least: int = 3) -> DataFrame:
    """Median delay from the latest preamble to an onset of energy, of the last ones of both, by key."""
    def recent(df):
        w = Window.partitionBy(*keys).orderBy(F.desc(time))
        return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last).drop("_k")

    p = recent(preambles).withColumn("_at", F.col(time))
    lags = as_of(recent(onsets), p, keys, time, "_at", "preamble").where("preamble is not null").withColumn("_lag", F.col(time) - F.col("preamble"))
    return lags.groupBy(*keys).agg(F.median("_lag").alias("latency_us"), F.count("*").alias("n")).where(F.col("n") >= least)


def _nodes(start: Column, end: Column, bucket: float) -> Column:
    """The fewest dyadic nodes (level, node) that make up the buckets of a span [start, end): two a level at most.

    Node j of level k is the buckets from j * 2^k on, 2^k of them. It is one of a span's if the span
    holds all of it but not all of its parent.
    """
    first, last = F.floor(start / bucket).cast("long"), F.ceil(end / bucket).cast("long")

    def level(k):
        low = -F.call_function("shiftright", -first, k)
        high = F.call_function("shiftright", last, k)
        odd = lambda v: v.bitwiseAND(F.lit(1)) == 1
        node = lambda j: F.struct(k.cast("int").alias("level"), j.alias("node"))
        return F.array_compact(F.array(F.when((low < high) & odd(low), node(low)), F.when((low < high) & odd(high), node(high - 1))))

    top = F.floor(F.log2((last - first).cast("double"))).cast("int") + 1
    return F.flatten(F.transform(F.sequence(F.lit(0), top), level))


def _begun_within(spans: DataFrame, points: DataFrame, keys: list[str], span: tuple[str, str], point: str, bucket: float) -> DataFrame:
    """Pairs of a span and a point in its buckets, each once: a span's nodes are apart, and one of them is the point's bucket or above it.

    Buckets are as many times as wide, a power of two, as spans are long by their geometric mean: a typical
    span is a few rows, and of the points in its buckets a fair share is in it. A point is looked up on the
    levels that spans have nodes on, which is one set of 63 numbers at most.
    """
    typical = spans.agg(F.avg(F.log2((F.col(span[1]) - F.col(span[0])) / bucket))).first()[0]
    bucket = bucket * 2.0 ** max(0, int(typical or 0))
    nodes = spans.withColumn("_n", F.explode(_nodes(F.col(span[0]), F.col(span[1]), bucket))).select(*spans.columns, "_n.*")
    levels = sorted(nodes.agg(F.collect_set("level")).first()[0])
    at = F.floor(F.col(point) / bucket).cast("long")
    above = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(at, k).alias("node")) for k in levels]) if levels else F.array().cast("array<struct<level:int,node:bigint>>"))
    return nodes.join(points.withColumn("_n", above).select(*points.columns, "_n.*"), [*keys, "level", "node"]).drop("level", "node")


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], bucket: float) -> DataFrame:
    """Pairs of rows whose spans [start, end) overlap, each once; empty spans and null keys meet none.

    Of two spans that overlap, the later begins within the earlier, so a pair is a span of one side and
    a beginning of the other (equal ones count as the right's). Spans are dealt to the dyadic nodes of
    their buckets, beginnings to the nodes above them: a span of n buckets is some 2 log n rows, not n.
    """
    a, b = (d.select(*keys, *[F.col(c).alias(f"{c}_{side}") for c in d.columns if c not in keys]).where(F.col(f"end_{side}") > F.col(f"start_{side}")) for d, side in ((left, "a"), (right, "b")))
    later = _begun_within(a, b, keys, ("start_a", "end_a"), "start_b", bucket).where("start_a <= start_b and start_b < end_a")
    earlier = _begun_within(b, a, keys, ("start_b", "end_b"), "start_a", bucket).where("start_b < start_a and start_a < end_b")
    return later.unionByName(earlier)


def met(left: DataFrame, right: DataFrame, keys: list[str], size: float) -> DataFrame:
    """The rows of left whose span [start, end) overlaps any of right's; empty spans and null keys meet none.

    A span is met if, of right's spans that begin before its end, the one that reaches furthest ends
    after its start. That is a running maximum over both sides in one order, in ranges of it, so no
    pairs are formed and a hot key is many tasks' work.
    """
    from .windows import running_max

    some = F.col("end") > F.col("start")
    for k in keys:
        some = some & F.col(k).isNotNull()
    # At equal places left's ends come first: a span that begins where another ends doesn't overlap it.
    a = left.where(some).withColumns({"_at": F.col("end"), "_side": F.lit(0), "_reach": F.lit(None).cast(right.schema["end"].dataType)})
    b = right.where(some).select(*keys, F.col("start").alias("_at"), F.lit(1).alias("_side"), F.col("end").alias("_reach"))
    d = running_max(a.unionByName(b, allowMissingColumns=True), "_reach", "_at", keys, size, "_furthest", ties=["_side"])
    return d.where("_side = 0 and _furthest > start").select(*left.columns)


def against_baseline(values: DataFrame, base: DataFrame) -> DataFrame:
    """(adva, number, key, value) with `sigma`: deviations from the address's baseline of that key."""
    b = base.select("adva", "key", "mean", "std")
    return values.join(b, ["adva", "key"], "left").withColumn("sigma", F.when(F.col("std") > 0, (F.col("value") - F.col("mean")) / F.col("std")))


def nearest_channel(df: DataFrame, hz: str, within: float = 1.0) -> DataFrame:
    """df with the channel whose centre is nearer than `within` Hz. 40 channels are broadcast."""
    c = channels(df.sparkSession).select(F.col("channel").alias("matched_channel"), F.col("frequency_hz").alias("_f"))
    return df.join(F.broadcast(c), F.abs(F.col(hz) - F.col("_f")) < within, "left").drop("_f")


def channels_in_view(df: DataFrame, centre: str, sample_rate: Column) -> DataFrame:
    """Each row with the channels whose centre lies in its band. 40 channels are broadcast."""
    c = channels(df.sparkSession).select(F.col("channel").alias("seen_channel"), F.col("frequency_hz").alias("seen_hz"))
    return df.join(F.broadcast(c), F.abs(F.col(centre) - F.col("seen_hz")) <= sample_rate / 2)
