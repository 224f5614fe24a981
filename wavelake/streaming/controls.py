"""Commands on a stream of blocks: which channel, gain, epoch and counter were in force at each block's time.

The stream form of plans.capture.tuned() and controlled(). Both sides are one stream keyed by session.
Rows wait in state until the watermark has passed their time, and are then gone through in order of
time, commands before blocks of the same time; a timer wakes a session that gets no more rows. A command that
comes later than the watermark allows is dropped by it (and counted by Spark), since its blocks are out.
Samples take no part: only clocks of blocks are kept, which name their block by session and index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Kinds of commands: another channel; another gain; totals start anew; no more samples count, until a start.
RETUNE, GAIN, CLEAR, STOP, START = "retune", "gain", "clear", "stop", "start"
_ROW = "time_us long, side int, block_index long, kind string, channel int, frequency_hz double, gain_db int, epoch int"
_NAMES = [c.split()[0] for c in _ROW.split(", ")]
#: Rows of settled(): stopped tells whether a stop was in force.
SETTLED = "session string, block_index long, event_time timestamp, channel int, frequency_hz double, gain_db int, epoch int, counter long, stopped boolean"


class _Settings(StatefulProcessor):
    """By session: rows that wait, and what is in force after those that are done."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.force = handle.getValueState("force", "channel int, frequency_hz double, gain_db int, epoch int, counter long, stopped boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            b = b[_NAMES].astype(object).where(b[_NAMES].notna(), None)
            new += [(int(r[0]), int(r[1]), *(None if v is None else kind(v) for kind, v in zip((int, str, int, float, int, int), r[2:], strict=True))) for r in b.itertuples(index=False, name=None)]
        self.waiting.appendList(new)
        # Awake when the last of them is past, however quiet the session is from then on.
        self.handle.registerTimer(max(r[0] for r in new) // 1000 + 1)
        yield from self._done(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._done(key, timerValues.getCurrentWatermarkInMs())

    def _done(self, key, watermark_ms: int) -> Iterator[pd.DataFrame]:
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], r[1], r[3] or "", r[2] or 0))
        n = sum(r[0] < watermark_ms * 1000 for r in rows)
        if not n:
            return
        channel, hz, gain, epoch, counter, stopped = self.force.get() if self.force.exists() else (None, None, None, -1, 0, False)
        out = []
        for time_us, side, index, kind, to_channel, to_hz, to_gain, own_epoch in rows[:n]:
            if side:
                own = (to_channel, to_hz) if epoch < 0 else (channel, hz)
                out.append((key[0], index, pd.Timestamp(time_us, unit="us", tz="UTC"), *own, to_gain if gain is None else gain, own_epoch if epoch < 0 else epoch, counter, stopped))
            elif kind == RETUNE:
                channel, hz, epoch = to_channel, to_hz, epoch + 1
            elif kind == GAIN:
                gain = to_gain
            elif kind == CLEAR:
                counter += 1
            elif kind in (STOP, START):
                stopped = kind == STOP
        self.force.update((channel, hz, gain, epoch, counter, stopped))
        if n < len(rows):
            self.waiting.put(rows[n:])
        else:
            self.waiting.clear()
        if out:
            d = pd.DataFrame(out, columns=[c.split()[0] for c in SETTLED.split(", ")])
            yield d.astype({"channel": "Int32", "gain_db": "Int32", "epoch": "Int32"})

    def close(self) -> None:
        pass


def settled(blocks: DataFrame, commands: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Streams (session, event_time, block_index, channel, frequency_hz, gain_db, epoch) and (session, event_time, kind, channel, frequency_hz, gain_db) -> SETTLED.

    Start it inside streaming.analysis.rocksdb(). late: how much later than others a row may come.
    """
    b = blocks.select("session", "event_time", F.lit(1).alias("side"), "block_index", F.lit(None).cast("string").alias("kind"), "channel", "frequency_hz", "gain_db", "epoch")
    c = commands.select("session", "event_time", F.lit(0).alias("side"), F.lit(None).cast("long").alias("block_index"), "kind", "channel", "frequency_hz", "gain_db", F.lit(None).cast("int").alias("epoch"))
    both = b.unionByName(c).withWatermark("event_time", late)
    both = both.select("session", "event_time", F.unix_micros("event_time").alias("time_us"), *_NAMES[1:])
    return both.groupBy("session").transformWithStateInPandas(_Settings(), SETTLED, "Append", "EventTime")
