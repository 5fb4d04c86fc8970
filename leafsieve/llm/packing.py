"""Packing token sequences into windows, online and in bounded space.

Each partition keeps a fixed number of open windows. A document's last piece goes to the
open window that it fills best; where none has room and no slot is free, the fullest window
is filled with the head of the piece and emitted. What is still open at the end of the
partitions is merged in groups of a fixed number of partitions: the pieces are laid end to
end and cut at the window, and the tail of a group is cut at powers of two, which need no
padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.textwork import slices, tidy
from leafsieve.llm.word_ids import encoder
from leafsieve.runtime import materialize, ship

WINDOW = 2048
#: Open windows of a partition.
OPEN = 64
#: A gap of fewer tokens than this is padded, not filled with a sliver of a document.
SLIVER = 8
#: Partitions whose open windows are merged in one task: at most MERGE * OPEN windows.
MERGE = 16
#: The id that ends a document.
END = 1

_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()),
])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, part int"


class Packer:
    """Open windows of one partition. Pieces are (doc_id, start, bytes of ids, doc_tokens)."""

    def __init__(self, window: int = WINDOW, slots: int = OPEN, sliver: int = SLIVER):
        self.window, self.slots, self.sliver = window, slots, sliver
        self.room: list[tuple[int, int]] = []  # (free tokens, number), ascending
        self.held: dict[int, list] = {}
        self.number = 0

    def add(self, doc_id, data: bytes) -> Iterator[list]:
        """Take a document; yields the windows that are complete."""
        total, at, width = len(data) // 4, 0, self.window
        while total - at >= width:
            yield [(doc_id, at, data[4 * at : 4 * (at + width)], total)]
            at += width
        while at < total:
            need = total - at
            k = bisect_left(self.room, (need, -1))
            if k < len(self.room):
                free, number = self.room.pop(k)
                self.held[number].append((doc_id, at, data[4 * at :], total))
                at = total
                if free > need:
                    insort(self.room, (free - need, number))
                else:
                    yield self.held.pop(number)
            elif len(self.room) < self.slots:
                self.held[self.number] = [(doc_id, at, data[4 * at :], total)]
                insort(self.room, (width - need, self.number))
                self.number += 1
                at = total
            else:
                free, number = self.room.pop(0)
                if free >= self.sliver:
                    self.held[number].append((doc_id, at, data[4 * at : 4 * (at + free)], total))
                    at += free
                yield self.held.pop(number)

    def rest(self) -> list[list]:
        """The windows that are still open, the fullest first."""
        return [self.held[number] for _, number in self.room]


def _rows(windows: Iterable[tuple[int, list]], part: int | None, keep_ids: bool) -> pa.RecordBatch:
    """A row per piece of some (sequence_id, pieces); part is set for windows that are still open."""
    cols: list[list] = [[] for _ in range(9)]
    for number, pieces in windows:
        offset = 0
        for doc_id, start, data, total in pieces:
            length = len(data) // 4
            for col, value in zip(cols, (doc_id, start, length, zlib.crc32(data), total, number, offset, data if keep_ids or part is not None else None, part), strict=True):
                col.append(value)
            offset += length
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)


def _pack_partition(path: str, window: int, slots: int, sliver: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode, packer, number = encoder(path).encode, Packer(window, slots, sliver), part << 32
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, held in slices(batch.column(1).cast(pa.binary()).to_pylist()):
                done = []
                for k, data in enumerate(encode(held)):
                    for pieces in packer.add(ids[first + k], data + end):
                        done.append((number, pieces))
                        number += 1
                yield _rows(done, None, keep_ids)
            tidy()
        yield _rows(((number + k, pieces) for k, pieces in enumerate(packer.rest())), part, keep_ids)

    return run


def lay_out(pieces: Iterable[tuple], window: int) -> Iterator[list]:
    """Pieces end to end, cut at the window; the tail is cut into powers of two."""
    now, size = [], 0
    for doc_id, start, data, total in pieces:
        at = 0
        while at < len(data) // 4:
            take = min(window - size, len(data) // 4 - at)
            now.append((doc_id, start + at, data[4 * at : 4 * (at + take)], total))
            at, size = at + take, size + take
            if size == window:
                yield now
                now, size = [], 0
    while size:
        width = 1 << size.bit_length() - 1
        head, tail, room = [], [], width
        for doc_id, start, data, total in now:
            take = min(room, len(data) // 4)
            if take:
                head.append((doc_id, start, data[: 4 * take], total))
            if 4 * take < len(data):
                tail.append((doc_id, start + take, data[4 * take :], total))
            room -= take
        yield head
        now, size = tail, size - width


def _merge(window: int, keep_ids: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        pieces = zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        number = (1 << 62) + (key[0].as_py() << 32)
        return pa.Table.from_batches([_rows(((number + k, w) for k, w in enumerate(lay_out(pieces, window))), None, keep_ids)], schema=_ARROW)

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, slots: int = OPEN, sliver: int = SLIVER, keep_ids: bool = True,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Every document, one with a null or empty text too, ends with the id ``END``; each id lies
    in one piece. A sequence has at most ``window`` ids; only sequences that are neither full
    nor a power of two long need padding, and those lack fewer than ``sliver`` ids. ``ids``
    (little-endian 32-bit) are null without ``keep_ids``. Repeated rows are packed as they
    come, an empty table gives no piece, further columns are ignored, and the ids of
    documents, which are cast to long, may be null. Any tokenizer file will do; ids are those of whole texts. Only open windows, at most ``slots`` a partition, are shuffled.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    packed = source.mapInArrow(_pack_partition(tokenizer_path, window, slots, sliver, keep_ids), _DDL)
    packed = materialize(packed, "packed")
    still_open = packed.where("part is not null").withColumn("merge", F.expr(f"part div {MERGE}"))
    merged = still_open.groupBy("merge").applyInArrow(_drop_merge(_merge(window, keep_ids)), _DDL)
    return packed.where("part is null").unionByName(merged).drop("part")


def _drop_merge(run):
    return lambda key, table: run(key, table.drop_columns(["merge"]))
