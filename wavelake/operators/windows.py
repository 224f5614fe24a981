"""Ordered operators on packet rows, as window expressions within an address, bin or trace."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions.scalars import finite
from ..tables import held
from .stats import admitted, latest


def two_mode_split(df: DataFrame, keys: list[str], value: str, fraction: float = C.SPLIT_FRACTION, least: int = C.SPLIT_LEAST, trim: int = 0) -> DataFrame:
    """The best cut of each key's values in two: (keys, sigma, low_mean, high_mean, n_low, n).

    sigma is the distance of the two means in pooled population deviations; both sides hold at least
    `fraction` of the values and three (and `trim` fewer cuts are tried at the upper end). Moments are
    taken about the key's mean, so that large values lose no digits.
    """
    own = Window.partitionBy(*keys)
    d = df.select(*keys, finite(F.col(value)).alias("_v")).where("_v is not null").withColumn("_n", F.count("*").over(own)).where(F.col("_n") >= least)
    d = d.withColumn("_m", F.avg("_v").over(own)).withColumn("_d", F.col("_v") - F.col("_m"))
    up = own.orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_k", F.row_number().over(own.orderBy("_d"))).withColumn("_s", F.sum("_d").over(up)).withColumn("_q", F.sum(F.col("_d") * F.col("_d")).over(up))
    d = d.withColumn("_all", F.sum("_d").over(own)).withColumn("_allq", F.sum(F.col("_d") * F.col("_d")).over(own))
    smallest = F.greatest(F.floor(F.col("_n") * fraction), F.lit(3))
    d = d.where((F.col("_n") - smallest > smallest) & F.col("_k").between(smallest, F.col("_n") - smallest - trim))
    rest = F.col("_n") - F.col("_k")
    low, high = F.col("_s") / F.col("_k"), (F.col("_all") - F.col("_s")) / rest
    var_low = F.greatest(F.col("_q") / F.col("_k") - low * low, F.lit(0.0))
    var_high = F.greatest((F.col("_allq") - F.col("_q")) / rest - high * high, F.lit(0.0))
    pooled = F.sqrt((var_low + var_high) / 2)
    d = d.withColumn("_low", low).withColumn("_high", high).withColumn("_sigma", F.when(pooled > 1e-12, (high - low) / F.greatest(pooled, F.lit(1e-12))).otherwise(0.0))
    best = F.max(F.struct("_sigma", (-F.col("_k")).alias("k"), "_low", "_high", "_m"))
    d = d.groupBy(*keys).agg(best.alias("_b"), F.max("_n").alias("n"))
    return d.select(*keys, F.col("_b._sigma").alias("sigma"), (F.col("_b._low") + F.col("_b._m")).alias("low_mean"), (F.col("_b._high") + F.col("_b._m")).alias("high_mean"), (-F.col("_b.k")).alias("n_low"), "n")


def unpivoted(packets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows of (adva, number, key, value) from one column for each key."""
    columns = [F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in keys]
    return packets.select("adva", "number", F.explode(F.array(*columns)).alias("_kv")).select("adva", "number", "_kv.key", "_kv.value")


def bimodal(packets: DataFrame, keys: tuple[str, ...], history: int = C.BIMODAL_HISTORY, least: int = C.BIMODAL_LEAST, sigma: float = C.BIMODAL_SIGMA) -> DataFrame:
    """Each address's most clearly split feature over its last values, and whether that is an alert."""
    order = {k: i for i, k in enumerate(keys)}
    rows = unpivoted(admitted(packets), keys).withColumn("value", finite(F.col("value"))).where("value is not null")
    split = two_mode_split(latest(rows, ["adva", "key"], "number", history), ["adva", "key"], "value").where(F.col("n") >= least)
    place = F.element_at(F.create_map(*[x for k, i in order.items() for x in (F.lit(k), F.lit(i))]), F.col("key"))
    best = split.withColumn("_p", -place).groupBy("adva").agg(F.max(F.struct("sigma", "_p", "key", "low_mean", "high_mean", "n_low", "n")).alias("b"))
    return best.select("adva", "b.key", "b.sigma", "b.low_mean", "b.high_mean", "b.n_low", "b.n", (F.col("b.sigma") > sigma).alias("alert"))


def bursts(packets: DataFrame, within_us: float = C.BURST_US, rows: int = C.BURST_ROWS, count: int = C.BURST_COUNT, by: list[str] = ()) -> DataFrame:
    """Packets with how many of their address's last rows, themselves included, lie within the span; and whether that is an alert."""
    w = Window.partitionBy(*by, "adva").orderBy("number").rowsBetween(-(rows - 1), 0)
    near = F.size(F.filter(F.collect_list("timestamp_us").over(w), lambda t: F.col("timestamp_us") - t < within_us))
    d = admitted(packets).withColumn("recent", near)
    return d.withColumn("burst", F.col("recent") > count)


def gap_segments(df: DataFrame, keys: list[str], time_s: str, order: str, gap_s: float = C.SERIES_GAP_S, size: int | None = None) -> DataFrame:
    """df with `segment`: a series' pieces, parted where time leaps. With a size, in ranges of the order, see with_previous()."""
    if size is not None:
        d = with_previous(df, [time_s], order, keys, size)
        d = d.withColumn("_leap", F.coalesce((F.col(time_s) - F.col(f"_before.{time_s}") > gap_s).cast("int"), F.lit(0))).drop("_before")
        return running_sums(d, {"segment": F.col("_leap")}, order, keys, size).drop("_leap")
    w = Window.partitionBy(*keys).orderBy(order)
    leap = F.coalesce((F.col(time_s) - F.lag(time_s).over(w) > gap_s).cast("int"), F.lit(0))
    return df.withColumn("_leap", leap).withColumn("segment", F.sum("_leap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_leap")


def gap_breaks(df: DataFrame, keys: list[str], time_s: str, order: str, value: str, gap_s: float = C.SERIES_GAP_S) -> DataFrame:
    """df with a row of null value before each leap in time, so that a line drawn through it breaks."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_leap", F.coalesce(F.col(time_s) - F.lag(time_s).over(w) > gap_s, F.lit(False)))
    d = d.withColumn("_row", F.explode(F.when(F.col("_leap"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1))))).drop("_leap")
    return d.withColumn(value, F.when(F.col("_row") == 1, F.col(value))).withColumnRenamed("_row", "point")


def peak_hold(df: DataFrame, bin_: str, frame: str, db: str, decay: float = C.PEAK_DECAY_DB, size: int | None = None) -> DataFrame:
    """df with `peak`: the largest level so far, falling by decay with each frame of the bin.

    max(peak - decay, db) in turn is max over earlier frames of db + decay * i, less decay * now.
    With a size, frames are counted and held in ranges, see running_max(); frames must differ within a bin.
    """
    if size is not None:
        d = running_sums(df, {"_i": F.lit(1)}, frame, [bin_], size)
        d = running_max(d.withColumn("_up", F.col(db) + decay * F.col("_i")), "_up", frame, [bin_], size, "_top")
        return d.select(*df.columns, (F.col("_top") - decay * F.col("_i")).alias("peak"))
    w = Window.partitionBy(bin_).orderBy(frame)
    i = F.row_number().over(w)
    d = df.withColumn("_i", i)
    return d.withColumn("peak", F.max(F.col(db) + decay * F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - decay * F.col("_i")).drop("_i")


def change_points(df: DataFrame, keys: list[str], order: str, value: str, least: float = 1e-6, epoch: str | None = None, size: int | None = None) -> DataFrame:
    """The rows at which a trace changes by more than least; with epoch, also those of a new epoch, and `moved` and `new_epoch` tell which.

    With a size, in ranges of the order, see with_previous().
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn(value, finite(F.col(value))).where(F.col(value).isNotNull())
    if size is not None:
        own = d.columns
        d = with_previous(d, [value] if epoch is None else [value, epoch], order, keys, size)
        moved = F.col(f"_before.{value}").isNull() | (F.abs(F.col(value) - F.col(f"_before.{value}")) > least)
        if epoch is None:
            return d.where(moved).select(*own)
        d = d.withColumn("new_epoch", F.coalesce(F.col(f"_before.{epoch}") != F.col(epoch), F.lit(False))).withColumn("moved", moved)
        return d.where("moved or new_epoch").drop("_before")
    before = F.lag(value).over(w)
    moved = before.isNull() | (F.abs(F.col(value) - before) > least)
    if epoch is None:
        return d.withColumn("_moved", moved).where("_moved").drop("_moved")
    fresh = F.coalesce(F.lag(epoch).over(w) != F.col(epoch), F.lit(False))
    return d.withColumn("new_epoch", fresh).withColumn("moved", moved).where("moved or new_epoch")


def bin_breaks(df: DataFrame, bin_: str, width: float) -> DataFrame:
    """Bins in order with `break_before` where the step from the last one is over a width. One row for each bin."""
    w = Window.partitionBy(F.lit(0)).orderBy(bin_)
    return df.withColumn("break_before", F.coalesce(F.col(bin_) - F.lag(bin_).over(w) > width, F.lit(False)))


def boxcar(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """df with `total`: the sum of this and the next n - 1 values; the tail repeats the last full one."""
    own = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("_s", F.sum(value).over(own.rowsBetween(0, n - 1))).withColumn("_c", F.count(value).over(own.rowsBetween(0, n - 1)))
    full = F.last(F.when(F.col("_c") == n, F.col("_s")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("total", full).drop("_s", "_c")


def islands(df: DataFrame, keys: list[str], position: str, score: str, gap: float, size: int | None = None) -> DataFrame:
    """The best-scored position (the first of equals) of each run of positions that lie within gap of the one before.

    With a size, runs are found in ranges of the position, see with_previous(), and may pass over any number of them.
    """
    if size is not None:
        at = with_previous(df.groupBy(*keys, position).agg(F.max(score).alias(score)), [position], position, keys, size)
        at = at.withColumn("_new", F.coalesce((F.col(position) - F.col(f"_before.{position}") > gap).cast("int"), F.lit(1))).drop("_before")
        d = running_sums(at, {"_island": F.col("_new")}, position, keys, size)
    else:
        w = Window.partitionBy(*keys).orderBy(position)
        new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(1))
        d = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct(F.col(score).alias("s"), (-F.col(position)).alias("p")))
    return d.groupBy(*keys, "_island").agg(best.alias("_b")).select(*keys, (-F.col("_b.p")).alias(position), F.col("_b.s").alias(score))


def merged_spans(df: DataFrame, keys: list[str], start: str, end: str, size: float | None = None) -> DataFrame:
    """Half-open spans with those that touch or overlap made one.

    With a size, starts are gone through in ranges of it: how far earlier ranges reach is one row for
    each (running_max()), so a span of any length is met and a hot key is many tasks' work.
    """
    if size is not None:
        own = df.select(*keys, start, end).distinct()
        d = running_max(own, end, start, keys, size, "_reach", ties=[end], before=True)
        d = d.withColumn("_new", F.coalesce((F.col(start) > F.col("_reach")).cast("int"), F.lit(1)))
        d = running_sums(d, {"_span": F.col("_new")}, start, keys, size, ties=[end])
    else:
        w = Window.partitionBy(*keys).orderBy(start, end)
        reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
        d = df.withColumn("_new", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1)))
        d = d.withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_span").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_span")


def energetic_spans(df: DataFrame, keys: list[str], index: str, on: Column, before: int, after: int) -> DataFrame:
    """Spans of sample indices at which a gate is on, widened on both sides, overlaps made one."""
    spans = df.where(on).select(*keys, (F.col(index) - before).alias("start"), (F.col(index) + 1 + after).alias("end"))
    return merged_spans(spans, keys, "start", "end")


def lost_samples(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks' clocks with `lost`: samples missing before them, where this and the last block's clock are valid.

    Binary columns are left out, so that no samples are sorted.
    """
    blocks = blocks.drop(*[f.name for f in blocks.schema.fields if f.dataType.simpleString() == "binary"])
    w = Window.partitionBy(*keys).orderBy("block_index")
    gap = F.col("first_sample") - (F.lag("first_sample").over(w) + F.lag("n_samples").over(w))
    both = F.col("timestamp_valid") & F.coalesce(F.lag("timestamp_valid").over(w), F.lit(False))
    return blocks.withColumn("lost", F.when(both & (gap > 0), gap).otherwise(0))


def swept(blocks: DataFrame, keys: list[str], rows: int = 240, least: int = 8, spread_hz: float = 500e3) -> DataFrame:
    """Blocks with `swept`: whether the bandwidth of the last ones varies by more than the spread."""
    w = Window.partitionBy(*keys).orderBy("block_index").rowsBetween(-(rows - 1), 0)
    d = blocks.withColumn("_b", finite(F.col("occupied_bandwidth_hz")))
    return d.withColumn("bandwidth_spread", F.stddev_pop("_b").over(w)).withColumn("swept", (F.count("*").over(w) > least) & F.coalesce(F.col("bandwidth_spread") > spread_hz, F.lit(False))).drop("_b")


def first_seen_labels(df: DataFrame, keys: list[str], order: str, size: int = 1_000_000, by: list[str] = ()) -> DataFrame:
    """(by, keys, label): numbers in the order in which keys first appear within by. One row for each key, ranked in blocks of the order."""
    seen = held(df.groupBy(*by, *keys).agg(F.min(order).alias("_first")))
    ranked = running_sums(seen, {"label": F.lit(1)}, "_first", list(by), size=size, ties=keys)
    return ranked.select(*by, *keys, (F.col("label") - 1).alias("label"))


def colours(df: DataFrame, key: str, order: str, n: int = 16) -> DataFrame:
    """(key, colour): a number below n for each key, by first appearance."""
    return first_seen_labels(df, [key], order).select(key, (F.col("label") % n).alias("colour"))


def _earlier(totals: DataFrame, names: list[str], keys: list[str], size: int) -> DataFrame:
    """(keys, _block, sums) -> the sums over a key's blocks before each, in blocks of blocks: no window holds more than `size` of them."""
    up = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    t = totals.withColumn("_group", F.floor(F.col("_block") / size))
    g = t.groupBy(*keys, "_group").agg(*[F.sum(n).alias(n) for n in names])
    g = g.select(*keys, "_group", *[zero(F.sum(n).over(up(*(keys or [F.lit(0)])).orderBy("_group"))).alias(f"_g_{n}") for n in names])
    t = t.join(g, [*keys, "_group"])
    return t.select(*keys, "_block", *[(zero(F.sum(n).over(up(*keys, "_group").orderBy("_block"))) + F.col(f"_g_{n}")).alias(f"_0_{n}") for n in names])


def running_sums(df: DataFrame, sums: dict[str, Column], order: str, keys: list[str] = (), size: int = 100_000, ties: list[str] = ()) -> DataFrame:
    """df with a running total of each of `sums` up to and with the row, in the order (a number) within keys without nulls.

    Rows fall into blocks by a range of the order, blocks into blocks of blocks; windows run within
    these, so neither a hot key nor a sparse order is one task's work.
    """
    keys, names = list(keys), list(sums)
    d = df.withColumn("_block", F.floor(F.col(order) / size)).withColumns({f"_s_{n}": c for n, c in sums.items()})
    before = _earlier(held(d.groupBy(*keys, "_block").agg(*[F.sum(f"_s_{n}").alias(n) for n in names])), names, keys, size)
    run = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    d = d.join(before, [*keys, "_block"])
    return d.select(*df.columns, *[(F.sum(f"_s_{n}").over(run) + F.col(f"_0_{n}")).alias(n) for n in names])


def _with_earlier(d: DataFrame, earlier: DataFrame, keys: list[str]) -> DataFrame:
    """d with earlier's columns of its keys (nulls are a key too) and _block, which has one row for each."""
    e = earlier.withColumnsRenamed({k: f"_e_{k}" for k in [*keys, "_block"]})
    same = F.col("_block") == F.col("_e__block")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    return d.join(e, same, "left").drop(*[f"_e_{k}" for k in [*keys, "_block"]])


def with_previous(df: DataFrame, columns: list[str], order: str, keys: list[str] = (), size: int = 100_000) -> DataFrame:
    """df with `_before`, a struct of the columns of the row before in the order (a number, without ties) within keys; null for the first.

    Rows fall into blocks by a range of the order; what a block begins with is the last row of the latest
    block before that has any, one row a block, so a hot key's rows are many tasks' work.
    """
    keys, row = list(keys), F.struct(*columns)
    d = df.withColumn("_block", F.floor(F.col(order) / size))
    lasts = d.groupBy(*keys, "_block").agg(F.max_by(row, F.col(order)).alias("_l"))
    lasts = lasts.select(*keys, "_block", F.lag("_l").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block")).alias("_carried"))
    d = _with_earlier(d, lasts, keys)
    own = F.lag(row).over(Window.partitionBy(*keys, "_block").orderBy(order))
    return d.select(*df.columns, F.coalesce(own, F.col("_carried")).alias("_before"))


def running_max(df: DataFrame, value: str, order: str, keys: list[str] = (), size: int = 100_000, to: str = "running_max", ties: list[str] = (), before: bool = False) -> DataFrame:
    """df with the largest value up to and with each row, or of the rows before it alone, in the order (a number) within keys.

    In blocks of a range of the order, as with_previous(): earlier blocks' largest values are one row each.
    """
    keys = list(keys)
    d = df.withColumn("_block", F.floor(F.col(order) / size))
    up = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    tops = d.groupBy(*keys, "_block").agg(F.max(value).alias("_m")).select(*keys, "_block", F.max("_m").over(up).alias("_carried"))
    run = Window.partitionBy(*keys, "_block").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    return _with_earlier(d, tops, keys).select(*df.columns, F.greatest(F.max(value).over(run), F.col("_carried")).alias(to))


def _maps_before(d: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Rows (keys, order, _g, _o0..) of maps x -> _g x + _o with _a, _b0..: the maps before each in its key, composed."""
    places = [f"_o{k}" for k in range(n)]
    out = [*keys, order, "_g", *places]
    schema = T.StructType([*[d.schema[c] for c in out], *[T.StructField(c, T.DoubleType()) for c in ("_a", *[f"_b{k}" for k in range(n)])]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, b = None, 1.0, [0.0] * n
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            key = list(zip(*[columns[k].to_pylist() for k in keys], strict=True)) if keys else [()] * batch.num_rows
            maps = np.column_stack([columns[c].to_numpy(zero_copy_only=False) for c in ("_g", *places)]).tolist()
            done = []
            for k, (g, *o) in zip(key, maps, strict=True):
                if k != now:
                    now, a, b = k, 1.0, [0.0] * n
                done.append([a, *b])
                a, b = g * a, [g * x + y for x, y in zip(b, o, strict=True)]
            found = np.array(done, float).reshape(-1, n + 1)
            yield pa.RecordBatch.from_arrays([*[columns[c] for c in out], *[pa.array(found[:, k]) for k in range(n + 1)]], schema.names)

    dealt = d.repartition(*keys) if keys else d.coalesce(1)
    return dealt.sortWithinPartitions(*keys, order).select(*out).mapInArrow(run, schema)


def affine_scan(df: DataFrame, gain: Column, offsets: dict[str, Column], order: str, keys: list[str] = (), size: int = 65_536) -> DataFrame:
    """(keys, order, scale, offsets' names): the maps x -> gain x + offset of all rows up to and with each, composed.

    A recurrence that begins with x is scale * x + offset after a row; one gain serves several offsets.
    The order is a whole number without ties. Composing is associative: rows are composed in blocks of a
    range of the order, in parallel; a block's whole map is one row, and only these are gone through one
    after the other within a key. Missing gains and offsets leave all as it was.
    """
    keys, names = list(keys), list(offsets)
    n, known = len(names), gain.isNotNull()
    for c in offsets.values():
        known = known & c.isNotNull()
    slim = df.select(*keys, order, F.when(known, gain.cast("double")).otherwise(1.0).alias("_g"), *[F.when(known, c.cast("double")).otherwise(0.0).alias(f"_o{k}") for k, c in enumerate(offsets.values())])
    d = slim.withColumn("_block", F.floor(F.col(order) / size))
    own = held(_maps_before(d, [*keys, "_block"], order, n))
    after = [(F.col("_g") * F.col("_a")).alias("_g"), *[(F.col("_g") * F.col(f"_b{k}") + F.col(f"_o{k}")).alias(f"_o{k}") for k in range(n)]]
    totals = own.groupBy(*keys, "_block").agg(F.max_by(F.struct(*after), F.col(order)).alias("_t")).select(*keys, "_block", "_t.*")
    earlier = _maps_before(totals, keys, "_block", n).select(*keys, "_block", F.col("_a").alias("_a0"), *[F.col(f"_b{k}").alias(f"_z{k}") for k in range(n)])
    own = _with_earlier(own, earlier, keys)
    g, a = F.col("_g"), F.col("_a")
    return own.select(*keys, order, (g * a * F.col("_a0")).alias("scale"), *[(g * (a * F.col(f"_z{k}") + F.col(f"_b{k}")) + F.col(f"_o{k}")).alias(name) for k, name in enumerate(names)])


def followed(df: DataFrame, values: dict[str, Column], order: str, keys: list[str] = (), keep: float = 0.9, valid: Column | None = None, size: int = 65_536) -> DataFrame:
    """(keys, order, values' names): each value's follower in the order; the first is taken whole, then x becomes keep * x + (1 - keep) * value.

    Rows that are not valid, or that miss a value, change nothing; before the first valid one all is null.
    """
    keys = list(keys)
    good = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    for c in values.values():
        good = good & finite(c.cast("double")).isNotNull()
    d = df.select(*keys, order, *[F.when(good, c.cast("double")).alias(f"_v{k}") for k, c in enumerate(values.values())])
    first = d.where("_v0 is not null").groupBy(*keys).agg(F.min(order).alias("_first")).withColumn("_block", F.lit(0))
    d = _with_earlier(d.withColumn("_block", F.lit(0)), first, keys)
    begins = F.col(order) == F.col("_first")
    gain = F.when(begins, 0.0).otherwise(keep)
    scan = affine_scan(d, F.when(F.col("_v0").isNotNull(), gain), {name: F.col(f"_v{k}") * F.when(begins, 1.0).otherwise(1 - keep) for k, name in enumerate(values)}, order, keys, size)
    # The first value's gain of 0 makes all scales after it 0, whatever came before.
    return scan.select(*keys, order, *[F.when(F.col("scale") == 0, F.col(name)).alias(name) for name in values])


def moments(df: DataFrame, values: list[str], order: str, block_rows: int = 100_000, keys: list[str] = ()) -> DataFrame:
    """df with `_x`, its finite values as an array, and `_moments`: for each the (n, mean, std) of all rows of its key up to and with this one.

    std is the sample's, null below two rows. As running_sums(), in blocks of an order (a number); what
    earlier blocks sum to comes first in each block's rows, which are gone through in Arrow batches. All
    sums are taken about the mean of the key's first block, so that large means lose no digits.
    """
    keys = list(keys)
    d = df.withColumns({"_block": F.floor(F.col(order) / block_rows), "_x": F.array(*[finite(F.col(v)) for v in values])})
    # Totals and their sums over earlier blocks: one row for each block and value, whatever their number.
    t = d.select(*keys, "_block", F.posexplode("_x").alias("_p", "_v")).groupBy(*keys, "_block", "_p").agg(F.count("_v").alias("n"), F.avg("_v").alias("_m"), F.var_pop("_v").alias("_q"))
    t = held(t)
    centre = t.groupBy(*keys, "_p").agg(F.min_by("_m", F.when(F.col("n") > 0, F.col("_block"))).alias("c"))
    t = t.join(centre, [*keys, "_p"]).selectExpr(*keys, "_block", "_p", "n", "coalesce(n * (_m - c), 0D) a", "coalesce(n * (_q + (_m - c) * (_m - c)), 0D) q")
    before = _earlier(t, ["n", "a", "q"], [*keys, "_p"], block_rows).join(centre, [*keys, "_p"])
    place = F.struct(F.col("_p").alias("p"), F.col("_0_n").cast("double").alias("n"), F.col("_0_a").alias("a"), F.col("_0_q").alias("q"), F.coalesce("c", F.lit(0.0)).alias("c"))
    before = before.groupBy(*keys, "_block").agg(F.array_sort(F.collect_list(place)).alias("_before"))
    rows = d.withColumn("_row", F.lit(True)).unionByName(before.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, *keys, "_block").sortWithinPartitions(*keys, "_block", "_row", order)
    columns, wide = rows.columns, len(values)
    kept = [c for c in columns if c not in ("_block", "_before", "_row")]
    moment = pa.struct([("n", pa.int64()), ("mean", pa.float64()), ("std", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = a = q = c = None
        for b in batches:
            is_row = b.column(columns.index("_row")).to_numpy(zero_copy_only=False).astype(bool)
            before, x = b.column(columns.index("_before")), b.column(columns.index("_x"))
            out, edges = [], np.append(np.flatnonzero(~is_row), len(is_row))
            for i, j in zip([0, *edges[:-1]], edges, strict=True):
                if i < len(is_row) and not is_row[i]:
                    n, a, q, c = (np.array([e[k] for e in before[int(i)].as_py()]) for k in "naqc")
                    i += 1
                if i >= j:
                    continue
                part = x.slice(int(i), int(j - i)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, wide)
                seen = np.isfinite(part)
                y = np.where(seen, part - c, 0.0)
                ns, as_, qs = n + np.cumsum(seen, 0), a + np.cumsum(y, 0), q + np.cumsum(y * y, 0)
                n, a, q = ns[-1], as_[-1], qs[-1]
                some = np.maximum(ns, 1)
                mean, std = c + as_ / some, np.sqrt(np.maximum((qs - as_ * as_ / some) / np.maximum(ns - 1, 1), 0))
                flat = [pa.array(ns.reshape(-1).astype(np.int64)), pa.array(mean.reshape(-1), mask=(ns < 1).reshape(-1)), pa.array(std.reshape(-1), mask=(ns < 2).reshape(-1))]
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) * wide + 1, wide), pa.int32()), pa.StructArray.from_arrays(flat, fields=list(moment))))
            if out:
                rest = b.filter(pa.array(is_row))
                yield pa.RecordBatch.from_arrays([*[rest.column(columns.index(k)) for k in kept], pa.concat_arrays(out)], [*kept, "_moments"])

    schema = T.StructType([*[f for f in rows.schema.fields if f.name in kept], T.StructField("_moments", T.ArrayType(T.StructType([T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType())])))])
    return rows.mapInArrow(run, schema).select(*df.columns, "_x", "_moments")


def running_moments(df: DataFrame, values: list[str], order: str, block_rows: int = 100_000, keys: list[str] = ()) -> DataFrame:
    """df with <v>_n, <v>_mean and <v>_std (sample) of all rows of its key up to and with this one, see moments()."""
    d = moments(df, values, order, block_rows, keys)
    return d.selectExpr(*[f"`{c}`" for c in df.columns], *[f"_moments[{i}].{k} as `{v}_{k}`" for i, v in enumerate(values) for k in ("n", "mean", "std")])


def whitened(df: DataFrame, values: list[str], order: str, block_rows: int = 100_000, vector: str | None = None, by: list[str] = ()) -> DataFrame:
    """df with <v>_w, or all of them as one array named by vector: each value less the running mean within by, in running deviations.

    A deviation of none counts as one, a missing value as 0.
    """
    d = moments(df, values, order, block_rows, list(by))
    d = d.withColumn("_w", F.expr("zip_with(_x, _moments, (x, m) -> coalesce((x - m.mean) / if(m.std > 1e-12D, m.std, 1D), 0D))"))
    own = [f"`{c}`" for c in df.columns]
    return d.selectExpr(*own, f"_w as `{vector}`") if vector else d.selectExpr(*own, *[f"_w[{i}] as `{v}_w`" for i, v in enumerate(values)])


def rates(df: DataFrame, time: Column, seconds: int = 1) -> DataFrame:
    """Packets by tumbling window of event time."""
    return df.groupBy(F.window(time, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("packets")).select(F.col("w.start").alias("start"), (F.col("packets") / seconds).alias("packets_per_s"))
