import numpy as np
import pytest

from wavelake.sources.ring import HEADER, RING_BLOCKS, SLOT, Ring, losses, ring_blocks

SIZE, SLOTS = 16, 8


class Writer:
    """A receiver's side of a ring: a slot is overwritten before the count goes on."""

    def __init__(self, path, channels=1):
        self.path, self.channels, self.n = path, channels, 0
        with open(path, "wb") as f:
            f.write(HEADER.pack(SLOTS, SIZE, channels, 0))
            f.write(bytes(SLOTS * (SLOT.size + 4 * SIZE * channels)))

    def block(self, k):
        return np.arange(k, k + 2 * SIZE * self.channels, dtype="<i2").tobytes()

    def write(self, count, samples=SIZE):
        with open(self.path, "r+b") as f:
            for _ in range(count):
                f.seek(HEADER.size + self.n % SLOTS * (SLOT.size + 4 * SIZE * self.channels))
                f.write(SLOT.pack(self.n, samples) + self.block(self.n))
                self.n += 1
                f.seek(0)
                f.write(HEADER.pack(SLOTS, SIZE, self.channels, self.n))


def run(spark, path, out, mark):
    q = ring_blocks(spark, path, "s", 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(RING_BLOCKS).parquet(out).orderBy("block_index").collect()


@pytest.mark.parametrize("channels", [1, 2])
def test_restart_reads_each_block_once(spark, tmp_path, channels):
    path, out, mark = (str(tmp_path / k) for k in ("ring", "out", "mark"))
    w = Writer(path, channels)
    w.write(5)
    assert [r.block_index for r in run(spark, path, out, mark)] == list(range(5))
    w.write(7)  # wraps, but laps nothing that was not read
    rows = run(spark, path, out, mark)
    assert [r.block_index for r in rows] == list(range(12)) and not any(r.lapped for r in rows)
    assert all(bytes(r.iq) == w.block(r.block_index) and r.first_sample == SIZE * r.block_index and r.n_samples == SIZE for r in rows)


def test_lapped_blocks_are_counted(spark, tmp_path):
    path, out, mark = (str(tmp_path / k) for k in ("ring", "out", "mark"))
    w = Writer(path)
    w.write(2)
    run(spark, path, out, mark)
    w.write(3 + SLOTS)  # blocks 2 to 4 are gone before they are read
    rows = run(spark, path, out, mark)
    assert [r.block_index for r in rows if r.lapped] == [2, 3, 4] and len(rows) == 13
    assert all(r.iq is None and r.n_samples == 0 for r in rows if r.lapped)
    w.write(1, samples=0)
    run(spark, path, out, mark)
    got = losses(spark.read.schema(RING_BLOCKS).parquet(out)).first()
    assert tuple(got) == ("s", 14, 3, 1, 10 * SIZE)


def test_a_query_starts_at_the_oldest_block(spark, tmp_path):
    path, out, mark = (str(tmp_path / k) for k in ("ring", "out", "mark"))
    w = Writer(path)
    w.write(20)
    rows = run(spark, path, out, mark)
    assert [r.block_index for r in rows] == list(range(12, 20)) and not any(r.lapped for r in rows)


def test_a_slot_in_writing_is_not_read(tmp_path):
    path = str(tmp_path / "ring")
    w = Writer(path)
    w.write(SLOTS)
    with open(path, "r+b") as f:  # the writer has begun block 8 in slot 0, and not yet counted it
        f.seek(HEADER.size)
        f.write(SLOT.pack(SLOTS, SIZE))
    ring = Ring(path)
    assert ring.read(0) is None and ring.read(1) == w.block(1) and ring.read(SLOTS) is None
