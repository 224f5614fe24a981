"""Removal of passages that occur earlier in the corpus, with a count-min prefilter.

A window is WINDOW consecutive words of one document. A word goes if a window over it has the same
words as a window that starts earlier (smaller doc_id, or the same document at an earlier word).

Documents are read in chunks: so many bytes of a partition's rows in their order.

1. Each chunk counts its windows in a count-min sketch of two rows whose counters stop at two. Its
   partial sketch is the touched cells, as sorted, compressed blocks; blocks are merged by row and
   place. A merged counter never lies below the true count, so a window that occurs twice is never
   lost. Each merged block answers each chunk with a bit for every cell that it sent: no sketch is held
   or sent as a whole, and its width follows the input's bytes without a bound.
2. A second pass brings a chunk's answers to it. It sends on only windows that both rows say may occur
   twice, its first of equal ones, and groups them exactly by a 96-bit hash to the first start of each.
3. First starts return to their chunks, beside the answers. A window that may be repeated and is no
   first start goes.

Defined cases: null text has no words; texts of fewer than WINDOW words lose none; a null doc_id
sorts before all others; texts that share a doc_id are documents of their own, in order of a hash of the
text; rows of equal doc_id and text are one document read several times, so that they get equal results
and windows at a first start are kept in each; no rows give no rows. The table must yield the same
rows in the same order whenever it is read, as files do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import compact, fresh, partitions, table, text_of, written
from .textarrays import WORD_BASE_2, Words, mixed, slices, utf8, window_hashes

WINDOW = 20
#: log2 of the cells in a row of the sketch at least; of the blocks of a row at least, and of a block's cells at most.
LEAST_BITS, BLOCK_BITS, BLOCK_CELLS = 16, 8, 26
#: Bytes of text of a chunk: these, and with more blocks more, so that a chunk has many cells in each; at most so many.
CHUNK_BYTES, MOST_CHUNK_BYTES = 12 << 20, 192 << 20
_FIRST_ID = -(1 << 63)
_SALT = np.uint64(0xA0761D6478BD642F)


def _cells(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - bits)
    return h >> shift, mixed(h ^ _SALT) >> shift


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 32 by planes of bytes, of which the high ones compress to little."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, size * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def _gaps(cells: np.ndarray) -> bytes:
    return _planes(np.diff(cells, prepend=cells.dtype.type(0)))


class Layout:
    """How wide a sketch of so many bytes of text is, and how it and the text are cut."""

    def __init__(self, volume: int, least_bits: int, most_bits: int | None = None):
        # Words have some six bytes: four times as many cells as windows.
        bits = max(least_bits, int(volume / 1.7).bit_length())
        self.bits = min(bits, most_bits) if most_bits else bits
        self.block_bits = min(self.bits, max(BLOCK_BITS, self.bits - BLOCK_CELLS))
        self.low = self.bits - self.block_bits
        self.chunk = min(MOST_CHUNK_BYTES, CHUNK_BYTES << max(0, self.block_bits - 12))


def _chunks(batches, text: int, size: int):
    """(number, batches) of runs of a partition's rows that have about size bytes of text. A chunk's batches are in memory.

    The last column, which is left out, is the partition's number in the table: a task's own number may
    be another one. Where a chunk ends depends on the rows alone, not on how they come in batches.
    """
    number, held, n = None, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if number is None:
            number = b.column(b.num_columns - 1)[0].as_py() << 32
        b = b.select(range(b.num_columns - 1))
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < b.num_rows:
            done = int(ends[at - 1]) if at else 0
            k = min(b.num_rows, int(np.searchsorted(ends, done + size - n)) + 1)
            held.append(b.slice(at, k - at))
            n += int(ends[k - 1]) - done
            at = k
            if n >= size:
                yield number, held
                number, held, n = number + 1, [], 0
    if held:
        yield number, held


def _parted(docs: DataFrame) -> DataFrame:
    """docs with the partition's number as the last column."""
    return docs.withColumn(fresh(docs.columns, "_part")[0], F.spark_partition_id().cast("long"))


def _windows(column: pa.Array, size: int):
    """(first text, words, starts of windows, hash of each) of slices of texts."""
    data, offsets = utf8(column)
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        words = Words(data[part[0] : part[-1]], part - part[0])
        at = words.windows(size)
        yield first, words, at, words.hashes()


def _all_windows(batches, text: int, size: int) -> np.ndarray:
    """The hashes of all windows of a chunk, in order."""
    parts = [window_hashes(h, at, size) for b in batches for _, _, at, h in _windows(b.column(text), size)]
    return np.concatenate([np.zeros(0, np.uint64), *parts])


_ASK = "row int, block long, chunk long, n int, cells binary, m int, again binary"


def _asked(docs: DataFrame, size: int, plan: Layout) -> DataFrame:
    """Each chunk's partial sketch: the cells it touches by row and block, and which of them twice."""
    low, mask = np.uint64(plan.low), np.uint64((1 << plan.low) - 1)

    def asked(batches):
        for chunk, held in _chunks(batches, 0, plan.chunk):
            h = _all_windows(held, 0, size)
            for row, cells in enumerate(_cells(h, plan.bits) if len(h) else ()):
                cells.sort()
                starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
                twice = np.diff(np.append(starts, len(cells))) > 1
                cells = cells[starts]
                block = cells >> low
                edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
                out = []
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    part = cells[a:z] & mask
                    again = part[twice[a:z]]
                    out.append((row, int(block[a]), chunk, z - a, _gaps(part), len(again), _gaps(again) if len(again) else b""))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _ASK.split(", ")])

    return _parted(docs.select("text")).mapInArrow(asked, _ASK)


def answers(docs: DataFrame, size: int, plan: Layout, parts: int) -> DataFrame:
    """(chunk, row, block, bits): for each cell that a chunk has sent, in order, whether its counter is two or more."""

    def merged(batches):
        now, held = None, []

        def done():
            seen, repeated = np.zeros(1 << plan.low, bool), np.zeros(1 << plan.low, bool)
            for _, n, cells, m, again in held:
                c = np.cumsum(_numbers(cells, n), dtype=np.uint32)
                repeated[c[seen[c]]] = True
                seen[c] = True
                if m:
                    repeated[np.cumsum(_numbers(again, m), dtype=np.uint32)] = True
            for chunk, n, cells, _, _ in held:
                bits = np.packbits(repeated[np.cumsum(_numbers(cells, n), dtype=np.uint32)])
                yield chunk, bits.tobytes()

        def shipped():
            rows = list(done())
            k = len(rows)
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([now[0]] * k, pa.int32()), pa.array([now[1]] * k, pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["chunk", "row", "block", "bits"])

        for b in batches:
            for row, block, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (row, block) != now:
                    if now is not None:
                        yield shipped()
                    now, held = (row, block), []
                held.append(rest)
        if now is not None:
            yield shipped()

    rows = _asked(docs, size, plan).repartition(parts, "row", "block").sortWithinPartitions("row", "block")
    return rows.mapInArrow(merged, "chunk long, row int, block long, bits binary")


class _Maybe:
    """Which windows of a chunk may be repeated, by the answers to it (in order of row and block)."""

    def __init__(self, plan: Layout):
        self.plan, self.rows = plan, ([], [])

    def add(self, row: int, block: int, bits: bytes) -> None:
        self.rows[row].append((block, bits))

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), bool)
        for cells, told in zip(_cells(h, self.plan.bits), self.rows, strict=True):
            unique, back = np.unique(cells, return_inverse=True)
            block = unique >> np.uint64(self.plan.low)
            edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(unique) else np.zeros(1, int)
            bits = {b: x for b, x in told}
            flags = [np.unpackbits(np.frombuffer(bits[int(block[a])], np.uint8), count=z - a) for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            out &= np.concatenate([np.zeros(0, np.uint8), *flags])[back].astype(bool)
        return out


def _payloads(docs: DataFrame, plan: Layout) -> DataFrame:
    """(chunk, payload): each chunk's rows, as compressed Arrow batches."""
    at = docs.columns.index("text")

    def packed(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        for chunk, held in _chunks(batches, at, plan.chunk):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=options) as out:
                for b in held:
                    out.write_batch(b)
            yield pa.record_batch([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "payload"])

    return _parted(docs).mapInArrow(packed, "chunk long, payload binary")


_MEETING = "chunk long, kind int, row int, block long, data binary"


def _met(parts: int, *sides: DataFrame) -> DataFrame:
    """Rows of _MEETING by chunk, its answers first, then what is returned to it, then its payload."""
    out = sides[0]
    for s in sides[1:]:
        out = out.unionAll(s)
    return out.repartition(parts, "chunk").sortWithinPartitions("chunk", "kind", "row", "block")


def _gathered(batches, plan: Layout):
    """(chunk, maybe, kept starts, repeated documents, batches) of each chunk in rows of _met()."""
    now = None
    for b in batches:
        for chunk, kind, row, block, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if chunk != now:
                now, maybe, kept, twice = chunk, _Maybe(plan), [], []
            if kind == 0:
                maybe.add(row, block, data)
            elif kind == 1:
                (kept if row == 0 else twice).append(data)
            else:
                with pa.ipc.open_stream(data) as rows:
                    yield chunk, maybe, kept, twice, list(rows)


def drop_repeats(docs: DataFrame, size: int = WINDOW, most_bits: int | None = None) -> DataFrame:
    """docs with _n_words, _n_removed and _kept_text: the words left, joined by one blank.

    most_bits bounds the sketch (for tests): the fuller it is, the more windows are grouped exactly,
    with the same result. The three names get a further _ where docs has them.
    """
    added = fresh(docs.columns, "_n_words", "_n_removed", "_kept_text")
    names = [f.name for f in docs.schema.fields]
    docs = docs.select(*[docs[c].cast("string").alias(c) if c == "text" else docs[c] for c in names])
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID))
    # Texts that share an id are told apart by a hash; those whose id is one row's need none.
    total, volume = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    plan, parts = Layout(volume, LEAST_BITS, most_bits), partitions(docs)
    shared = written(docs.groupBy(ids.alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), docs)
    any_shared = not shared.isEmpty()
    at_id, at_text = names.index("doc_id"), names.index("text")
    told = written(answers(docs, size, plan, parts), docs).select("chunk", F.lit(0).alias("kind"), "row", "block", F.col("bits").alias("data"))
    payload = _payloads(docs, plan).select("chunk", F.lit(2).alias("kind"), F.lit(0).alias("row"), F.lit(0).cast("long").alias("block"), F.col("payload").alias("data"))

    def numbered_ids(b: pa.RecordBatch) -> np.ndarray:
        return pc.fill_null(b.column(at_id).cast(pa.int64()), _FIRST_ID).to_numpy().astype(np.int64)

    twice = None
    if any_shared:

        def placed(batches):
            for chunk, held in _chunks(batches, 1, plan.chunk):
                out = [(i, tie) for b in held for i, tie in zip(b.column(0).to_pylist(), _ties(b.column(1)).tolist(), strict=True)]
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([chunk] * len(out), pa.int64())], ["id", "tie", "chunk"])

        where = _parted(docs.select(ids.alias("id"), "text")).mapInArrow(placed, "id long, tie long, chunk long").join(shared, "id").distinct()
        where = written(where, docs)
        twice = where.groupBy("chunk").agg(F.collect_set("id").alias("ids"))
        pack = F.pandas_udf(lambda x: x.map(lambda v: np.asarray(v, "<i8").tobytes()), T.BinaryType())
        twice = twice.select("chunk", F.lit(1).alias("kind"), F.lit(1).alias("row"), F.lit(0).cast("long").alias("block"), pack("ids").alias("data"))

    def documents(b: pa.RecordBatch, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own, ties = numbered_ids(b), np.zeros(b.num_rows, np.int64)
        if len(several):
            hit = np.isin(own, several)
            ties[hit] = _ties(b.column(at_text).filter(pa.array(hit)))
        return own, ties

    def candidates(batches):
        for chunk, maybe, _, twice_, held in _gathered(batches, plan):
            several = np.frombuffer(b"".join(twice_), "<i8")
            may, done, found = maybe.of(_all_windows(held, at_text, size)), 0, []
            for b in held:
                own, ties = documents(b, several)
                for first, words, at, h in _windows(b.column(at_text), size):
                    at, done = at[may[done : done + len(at)]], done + len(at)
                    if len(at):
                        of = np.searchsorted(words.of, at, "right") - 1
                        found.append((own[first + of], ties[first + of], at - words.of[of], window_hashes(h, at, size), window_hashes(h, at, size, WORD_BASE_2) >> np.uint64(32)))
            if not found:
                continue
            own, ties, start, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, ties, own, h2, h1))
            own, ties, start, h1, h2 = (x[order] for x in (own, ties, start, h1, h2))
            new = np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            rest = h2[new].astype(np.int64) << 32 | start[new]
            yield pa.record_batch([pa.array(h1[new].view(np.int64)), pa.array(rest), pa.array(own[new]), pa.array(ties[new]), pa.array(np.full(new.sum(), chunk))], ["h1", "rest", "id", "tie", "chunk"])

    sides = [told, payload] + ([twice] if any_shared else [])
    # Two numbers share a long: rows are shuffled by the million.
    found = _met(parts, *sides).mapInArrow(candidates, "h1 long, rest long, id long, tie long, chunk long").repartition(parts, "h1")
    found = found.select("h1", F.shiftright("rest", 32).alias("h2"), "id", "tie", F.col("rest").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"), "chunk")
    least = found.groupBy("h1", "h2").agg(F.min(F.struct("id", "tie", "start", "chunk")).alias("f"))
    key = F.shiftleft("f.start", 32).bitwiseOR(F.col("h1").bitwiseAND(F.lit(0xFFFFFFFF)))
    firsts = least.select(F.col("f.id").alias("id"), F.col("f.tie").alias("tie"), F.col("f.chunk").alias("chunk"), key.alias("key"))
    if any_shared:
        # A document that several chunks hold gets its first starts in each.
        firsts = written(firsts, docs)
        every = firsts.drop("chunk").join(where, ["id", "tie"]).select("id", "tie", "chunk", "key")
        firsts = firsts.join(shared, "id", "left_anti").select("id", "tie", "chunk", "key").unionAll(every)

    def returned(batches):
        for b in batches:
            chunk = b.column(2).to_numpy()
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], chunk[order][1:] != chunk[order][:-1], [True]])) if len(chunk) else np.zeros(1, int)
            three = np.stack([b.column(k).to_numpy() for k in (0, 1, 3)], 1)[order].astype("<i8")
            rows = [three[a:z].tobytes() for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            n = len(rows)
            yield pa.record_batch([pa.array(chunk[order][edges[:-1]]), pa.array([1] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(rows, pa.binary())], ["chunk", "kind", "row", "block", "data"])

    kept_starts = firsts.select("id", "tie", "chunk", "key").mapInArrow(returned, _MEETING)

    def cut(batches):
        for _, maybe, kept_, twice_, held in _gathered(batches, plan):
            several = np.frombuffer(b"".join(twice_), "<i8")
            own3 = np.frombuffer(b"".join(kept_), "<i8").reshape(-1, 3)
            order = np.lexsort((own3[:, 1], own3[:, 0]))
            own3 = own3[order]
            edge = np.concatenate([[0], np.flatnonzero((own3[1:, :2] != own3[:-1, :2]).any(1)) + 1, [len(own3)]]) if len(own3) else np.zeros(1, int)
            place = {(int(i), int(t)): k for k, (i, t) in enumerate(own3[edge[:-1], :2].tolist())} if len(own3) else {}
            may, done = maybe.of(_all_windows(held, at_text, size)), 0
            for b in held:
                ids_, ties = documents(b, several)
                n_words, n_removed, texts = [], [], []
                for first, words, at, h in _windows(b.column(at_text), size):
                    n = len(words.start)
                    gone = np.zeros(n, bool)
                    again, done = may[done : done + len(at)], done + len(at)
                    if again.any():
                        kept_at = np.full(n, -1, np.int64)
                        for k in range(len(words.of) - 1):
                            at_ = place.get((int(ids_[first + k]), int(ties[first + k])))
                            if at_ is not None:
                                keys = own3[edge[at_] : edge[at_ + 1], 2]
                                where_ = words.of[k] + (keys >> 32)
                                fits = where_ < words.of[k + 1]
                                kept_at[where_[fits]] = keys[fits] & 0xFFFFFFFF
                        at = at[again]
                        at = at[kept_at[at] != (window_hashes(h, at, size) & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                        cover = np.zeros(n + 1, np.int32)
                        np.add.at(cover, at, 1)
                        np.subtract.at(cover, at + size, 1)
                        gone = np.cumsum(cover[:-1]) > 0
                    sums = np.concatenate([[0], np.cumsum(gone)])
                    n_words.append(np.diff(words.of))
                    n_removed.append(np.diff(sums[words.of]))
                    texts.append(_joined(words.data, words, ~gone))
                counts = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (n_words, n_removed)]
                text = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
                yield pa.record_batch([*b.columns, *counts, text], [*names, *added])

    fields = [*docs.schema.fields, T.StructField(added[0], T.LongType()), T.StructField(added[1], T.LongType()), T.StructField(added[2], T.StringType())]
    return _met(parts, *sides, kept_starts).mapInArrow(cut, T.StructType(fields))


def _ties(column: pa.Array) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest((x.as_py() or "").encode()) >> 1 for x in column], np.int64)


def _joined(data: np.ndarray, words: Words, keep: np.ndarray) -> pa.Array:
    """For each text, its words of keep, joined by one blank."""
    start, end = words.start[keep], words.end[keep]
    of = np.searchsorted(np.flatnonzero(keep), words.of)  # the kept words of text i are of[i]:of[i + 1]
    lengths = end - start
    last = np.zeros(len(start), bool)
    last[of[1:][of[1:] > of[:-1]] - 1] = True
    width = lengths + ~last
    total = np.concatenate([[0], np.cumsum(width)])
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, start, 1)
    np.subtract.at(mask, end, 1)
    inside = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    gap = end[~last]
    inside[gap] = True
    out = data.copy()
    out[gap] = 0x20
    return pa.StringArray.from_buffers(len(of) - 1, pa.py_buffer(total[of].astype(np.int32)), pa.py_buffer(out[inside]))


def op5_passages(spark, sf_dir):
    """op5's digest over the whole documents table."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = compact(drop_repeats(docs), docs)
    return found.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept_text").cast("binary"), 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs' columns; texts that lose words are their kept words, and texts that lose all are left out.

    Texts that lose none stay as they are, null and empty ones too; n_chars, where it is a column,
    follows the text; rows of equal doc_id and text stay alike; an empty table gives no rows.
    """
    words, removed, kept = fresh(docs.columns, "_n_words", "_n_removed", "_kept_text")
    found = drop_repeats(docs).where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    found = found.withColumn("text", F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col(removed) > 0, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)
