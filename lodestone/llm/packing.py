"""Pack tokenised documents into fixed windows with bounded-space online packing.

Each partition keeps a fixed number of open windows. A document's full windows stand alone;
what is left of it goes best-fit, that is to the open window with the least room that still
takes it. If none does, the fullest window is emitted; a gap worth filling is first filled
with the document's head. Windows still open at the end of a partition are merged with those
of neighbouring partitions in groups of a fixed number, by best fit in order of size, so
no task gets more than ``fan_in`` times the open windows.

Defined cases: null or empty text is one end token. Rows with equal doc_id are packed one by
one, each with its own starts. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import encoder
from lodestone.llm.common import staged

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("window", pa.int64()), ("offset", pa.int64())])
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long"
_OPEN = 1 << 62  # marks windows that were open at the end of their partition


class OpenWindows:
    """At most ``most`` open windows of ``size`` tokens, found by their room."""

    def __init__(self, size: int, most: int, min_gap: int):
        self.size, self.most, self.min_gap = size, most, min_gap
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.next = 0

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> list[tuple[int, int, int]]:
        """Pieces (length, window, offset) of a run of tokens that is shorter than a window."""
        out = []
        while length:
            at = bisect.bisect_left(self.rooms, (length, -1))
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
            elif len(self.rooms) < self.most:
                room, window = self.size, self.fresh()
            else:
                room, window = self.rooms.pop(0)  # the fullest goes out
                if room >= self.min_gap:
                    out.append((room, window, self.size - room))
                    length -= room
                continue
            out.append((length, window, self.size - room))
            if room > length:
                bisect.insort(self.rooms, (room - length, window))
            length = 0
        return out


def _pack(vocab_path: str, end_id: int, size: int, most: int, min_gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, windows = encoder(vocab_path).encode, OpenWindows(size, most, min_gap)
        base, end, rows = TaskContext.get().partitionId() << 36, struct.pack("<I", end_id), []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                packed = (code(text) if text else b"") + end
                total, start = len(packed) // 4, 0
                whole = total // size
                pieces = [(size, windows.fresh(), 0) for _ in range(whole)] + windows.place(total - whole * size)
                for length, window, offset in pieces:
                    rows.append((doc_id, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]), total, base + window, offset))
                    start += length
            # a window is known to be closed only at the end, so rows wait; they are numbers
            if len(rows) > 200_000:
                still = {base + w for _, w in windows.rooms}
                done = [r for r in rows if r[5] not in still]
                rows = [r for r in rows if r[5] in still]
                if done:
                    yield _batch(done)
        still = {base + w for _, w in windows.rooms}
        if rows:
            yield _batch([(*r[:5], r[5] | _OPEN, r[6]) if r[5] in still else r for r in rows])

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


def _merge(size: int):
    """Best fit, the largest first, of the windows of one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fill", "window"], ascending=[False, True])
        rooms: list[tuple[int, int]] = []
        into, base = [], []
        for window, fill in zip(pdf["window"], pdf["fill"]):
            at = bisect.bisect_left(rooms, (fill, -1))
            room, target = rooms.pop(at) if at < len(rooms) else (size, window)
            into.append(target)
            base.append(size - room)
            if room > fill:
                bisect.insort(rooms, (room - fill, target))
        return pd.DataFrame({"window": pdf["window"], "into": into, "base": base})

    return run


def pack(docs: DataFrame, vocab_path: str, end_id: int = 1, size: int = 2048, open_windows: int = 128, min_gap: int = 24, fan_in: int = 32) -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = staged(narrow.mapInArrow(_pack(vocab_path, end_id, size, open_windows, min_gap), _PIECES_SQL), "pieces")
    closed = pieces.where(F.col("window") < _OPEN).withColumnRenamed("window", "sequence_id")
    left = pieces.where(F.col("window") >= _OPEN)
    fills = left.groupBy("window").agg(F.sum("length").alias("fill"))
    fills = fills.withColumn("__group", F.shiftright(F.col("window").bitwiseAND(_OPEN - 1), 36 + fan_in.bit_length() - 1))
    merged = fills.groupBy("__group").applyInPandas(_merge(size), "window long, into long, base long")
    moved = left.join(merged, "window").withColumn("offset", F.col("offset") + F.col("base")).withColumn("sequence_id", F.col("into"))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return closed.select(*cols).unionByName(moved.select(*cols))
