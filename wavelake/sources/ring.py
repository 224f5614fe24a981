"""Blocks of samples from a ring that a receiver keeps writing, as a streaming source.

A ring is a file of a fixed number of slots: HEADER (slots, samples of a slot, channels, blocks written
so far), then for each slot SLOT (number of its block, samples in it) and its samples. Block k lies in slot
k % slots until block k + slots takes it over. An offset is a number of blocks, so a query that starts
again from its checkpoint reads each block once.

A block that has been overwritten before it was read is lapped: its row is there with no samples and
`lapped`, so that losses are counted and never silent. A slot is read first and held against the ring's
state after that, since the writer may come round while it is read.

The file's path has to be the same on driver and executors.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Slots, samples of a slot, channels, blocks written; number of a slot's block, samples in it.
HEADER, SLOT = struct.Struct("<IIIQ"), struct.Struct("<QI")
#: Rows of the source: first_sample counts all blocks as full ones.
RING_BLOCKS = "session string, block_index long, first_sample long, n_samples int, n_channels int, iq binary, lapped boolean"


class Ring:
    """Reads a ring's file."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.slots, self.size, self.channels, _ = HEADER.unpack(self.file.read(HEADER.size))
        self.wide = SLOT.size + 4 * self.size * self.channels

    def written(self) -> int:
        return HEADER.unpack(os.pread(self.file.fileno(), HEADER.size, 0))[3]

    def read(self, index: int) -> bytes | None:
        """The samples of a block, or None if it is lapped or not there yet."""
        at = HEADER.size + index % self.slots * self.wide
        raw = os.pread(self.file.fileno(), self.wide, at)
        # A writer numbers a slot before it fills it: an equal number afterwards tells that the copy is whole.
        if len(raw) < SLOT.size or os.pread(self.file.fileno(), SLOT.size, at) != raw[: SLOT.size]:
            return None
        if not index < self.written() <= index + self.slots:
            return None
        own, n = SLOT.unpack_from(raw)
        if own != index or n > self.size:
            return None
        return raw[SLOT.size : SLOT.size + 4 * n * self.channels]

    def close(self) -> None:
        self.file.close()


class _Stretch(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class RingReader(DataSourceStreamReader):
    def __init__(self, path: str, session: str, blocks: int):
        self.path, self.session, self.blocks = path, session, blocks

    def _ring(self) -> tuple[int, int]:
        ring = Ring(self.path)
        try:
            return ring.written(), ring.slots
        finally:
            ring.close()

    def initialOffset(self) -> dict:
        """The oldest block that is still there when a query starts for the first time."""
        written, slots = self._ring()
        return {"block": max(0, written - slots)}

    def latestOffset(self) -> dict:
        return {"block": self._ring()[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, z = start["block"], end["block"]
        return [_Stretch(k, min(k + self.blocks, z)) for k in range(a, z, self.blocks)]

    def read(self, partition: _Stretch) -> Iterator[tuple]:
        ring = Ring(self.path)
        try:
            for k in range(partition.start, partition.end):
                raw = ring.read(k)
                n = len(raw) // (4 * ring.channels) if raw is not None else 0
                yield self.session, k, k * ring.size, n, ring.channels, raw, raw is None
        finally:
            ring.close()

    def commit(self, end: dict) -> None:
        pass


class RingSource(DataSource):
    """Source `wavelake_ring`; options path, session and blocks_per_task (64)."""

    @classmethod
    def name(cls) -> str:
        return "wavelake_ring"

    def schema(self) -> str:
        return RING_BLOCKS

    def streamReader(self, schema) -> RingReader:
        return RingReader(self.options["path"], self.options.get("session", ""), int(self.options.get("blocks_per_task", 64)))


def ring_blocks(spark: SparkSession, path: str, session: str = "", blocks_per_task: int = 64) -> DataFrame:
    """A stream of RING_BLOCKS."""
    spark.dataSource.register(RingSource)
    return spark.readStream.format("wavelake_ring").option("path", path).option("session", session).option("blocks_per_task", blocks_per_task).load()


def losses(blocks: DataFrame) -> DataFrame:
    """By session: blocks, those that were lapped, and those that came short of samples; for the complete or update mode."""
    short = ~F.col("lapped") & (F.col("n_samples") == 0)
    return blocks.groupBy("session").agg(F.count("*").alias("blocks"), F.count_if("lapped").alias("lapped"), F.count_if(short).alias("empty"), F.sum("n_samples").alias("samples"))
