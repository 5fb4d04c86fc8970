"""Substring deduplication by suffix sorting with bucket-pointer refinement.

A byte goes if a string of LENGTH bytes that covers it also starts earlier. Suffixes are not
sorted over the whole corpus at once: windows of LENGTH bytes are first dealt by their
anchor, the q-gram in them with the least hash. Equal windows have equal anchors, so a window
whose anchor comes once is unique, and only what is left needs sorting. Hashes and digests
only say which bytes meet where; what is equal is decided by :func:`repeats`, on the bytes:

1. ``_anchors``: each run of windows with one anchor is a row (hash of the anchor, place).
   Runs whose anchor comes again within a slice are refined there, and what repeats is settled.
2. ``_deal``: rows are dealt by the anchor's hash and streamed in order. Anchors with one run
   are dropped; the runs of the others go on, whole or, of anchors with many runs, in slices of a few
   windows keyed by the bytes that those share. Anchors that a Misra-Gries sketch names are sliced undealt.
3. ``_cut``: the bytes of the runs that go on are cut out of the texts; slices are refined in batches
   first, so an equal one is sent once a batch. Slices whose key is frequent, such as those at the ends of
   a passage that many texts hold, go one round further: ``_windows`` keys each window by all its bytes.
4. ``_grouped``: what meets under a key is refined; of a key with more than a batch only the first
   of what is equal is held.

:func:`refine` and :func:`same_strings` sort by initial buckets of eight bytes, which are refined by sorting
on the bucket pointers at later offsets; the refined pointers serve the next, twice as long, comparison.
Strings or windows that stay in one bucket over their whole length are equal, and all but the first are settled.

Settled windows are gathered by document and their bytes removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.rows import row_key
from leafsieve.llm.textwork import slices, tidy
from leafsieve.operators.heavy import heavy_hitters
from leafsieve.operators.ranking import with_position
from leafsieve.runtime import materialize, release, ship

#: Bytes of the strings that are looked for, of the q-grams that can be anchors, and of initial buckets.
LENGTH, GRAM, FIRST = 100, 32, 8
#: Most anchors that are named as frequent (bounds the broadcast), and counters of the sketch.
HEAVY, COUNTERS = 4096, 16384
#: Rows from which an anchor or a slice's key can count as frequent, and runs of an anchor that go on whole.
LEAST, GROUP = 1024, 4096
#: Windows in a slice of a frequent anchor.
SLICE = 8
#: Bytes that are sorted together, unless one key has more; bytes that are scanned at once.
BATCH, SCAN = 1 << 20, 1 << 20
#: Stands for a null id inside: it comes after every other.
NULL_ID = (1 << 63) - 1

_P = np.uint64(0x9E3779B97F4A7C15)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes at each place, by doubling."""
    with np.errstate(over="ignore"):
        h, size, power = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x100000001B3)
        while size < GRAM:
            h = h[:-size] * power + h[size:]
            power, size = power * power, 2 * size
        h ^= h >> np.uint64(31)
        h *= _P
        h ^= h >> np.uint64(29)
    return h


def _runs(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor's hash, first window, windows, anchor's place) of each run of ``valid`` windows of ``data`` with one anchor.

    The anchor of a window is its q-gram with the least hash (by 32 bits), the leftmost of equals, so
    it depends on the bytes of the window only.
    """
    h = _gram_hashes(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, size = LENGTH - GRAM + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    window = np.flatnonzero(valid[: len(least)])
    if not len(window):
        return (np.zeros(0, dtype=np.int64),) * 4
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1))))
    count = np.diff(np.append(new, len(window)))
    return h[anchor[new]].view(np.int64), window[new], count, anchor[new]


_ANCHORS = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int32()), ("lead", pa.int16())])
_ANCHORS_DDL = "h long, doc long, at long, n int, lead short"


def _scan(ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Rows of the runs of some texts. A null h marks windows that are settled: they came earlier."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    long = sizes >= LENGTH
    np.add.at(edge, begins[:-1][long], 1)
    np.add.at(edge, begins[1:][long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    parts = []
    for at in range(0, len(data), SCAN):  # windows that start in a stretch
        piece = data[at : at + SCAN + LENGTH - 1]
        if len(piece) >= LENGTH:
            h, first, count, anchor = _runs(piece, valid[at : at + SCAN])
            parts.append((h, first + at, count, anchor + at))
    if not parts:
        return pa.RecordBatch.from_pylist([], schema=_ANCHORS)
    h, first, count, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
    row = np.searchsorted(begins, first, side="right") - 1
    doc, at = ids[row], first - begins[row]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    alone, again = np.flatnonzero(~again), np.flatnonzero(again)
    found = repeats(data, first[again], count[again] + (LENGTH - 1), h[again], doc[again], at[again])
    rest = left_over(count[again], found)
    some = again[rest[0]]
    cols = (
        (h[alone], h[some], np.zeros(len(found[0]), dtype=np.int64)),
        (doc[alone], doc[some], doc[again][found[0]]),
        (at[alone], at[some] + rest[1], at[again][found[0]] + found[1]),
        (count[alone], rest[2], found[2]),
        ((anchor - first)[alone], (anchor - first)[some] - rest[1], np.zeros(len(found[0]), dtype=np.int64)),
    )
    h, doc, at, n, lead = (np.concatenate(c) for c in cols)
    settled = np.arange(len(h)) >= len(alone) + len(some)
    return pa.RecordBatch.from_arrays([pa.array(h, mask=settled), pa.array(doc), pa.array(at), pa.array(n.astype(np.int32)), pa.array(lead.astype(np.int16))], schema=_ANCHORS)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for first, held in slices(batch.column(1).to_pylist()):
            yield _scan(ids[first : first + len(held)], held)
        tidy()


#: How a run goes on: whole, or in slices.
WHOLE, SLICED = 0, 1
_FATES = pa.schema([*_ANCHORS, ("fate", pa.int8())])
_FATES_DDL = f"{_ANCHORS_DDL}, fate byte"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, in the order of h, whose anchor comes again. Between batches at most GROUP rows are kept, however many share an anchor."""
    held, last, large = None, None, False  # rows of the last anchor, its hash, and whether it has more than GROUP
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]).cast(_ANCHORS)
        if large:
            size = int(np.searchsorted(table.column("h").to_numpy(), last, side="right"))
            yield from _fated(table.slice(0, size), SLICED)
            table = table.slice(size)
            if not table.num_rows:
                continue
        if held is not None:
            table = pa.concat_tables([held, table])
        h = table.column("h").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(starts, len(h)))
        last, open_ = h[-1], int(count[-1])
        large = open_ > GROUP
        held = None if large else table.slice(len(h) - open_).combine_chunks()
        count[-1] = open_ if large else 0
        each = np.repeat(count, np.diff(np.append(starts, len(h))))
        yield from _fated(table.filter(pa.array((each > 1) & (each <= GROUP))), WHOLE)
        yield from _fated(table.filter(pa.array(each > GROUP)), SLICED)
    if held is not None and held.num_rows > 1:
        yield from _fated(held, WHOLE)


def _fated(table: pa.Table, fate: int) -> list[pa.RecordBatch]:
    return table.append_column("fate", pa.array(np.full(table.num_rows, fate, dtype=np.int8))).cast(_FATES).to_batches()


_PIECES = pa.schema([("key", pa.int64()), ("payload", pa.binary()), ("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("sliced", pa.bool_())])
_PIECES_DDL = "key long, payload binary, doc long, at long, n long, sliced boolean"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(_PIECES)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _PIECES, strict=True)], schema=_PIECES)


def _strings(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of some strings, and where each begins, and its size."""
    sizes = np.fromiter(map(len, payloads), dtype=np.int64, count=len(payloads))
    return np.frombuffer(b"".join(payloads), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def _settled(payloads: list[bytes], keys: list[int], docs: list[int], places: list[int]) -> tuple[list[tuple], list[tuple[int, int, int]]]:
    """Of strings that meet in a task: rows of pieces for their settled windows, and (string, first window, windows) of what goes on."""
    data, begins, sizes = _strings(payloads)
    found = repeats(data, begins, sizes, np.array(keys, dtype=np.int64), np.array(docs, dtype=np.int64), np.array(places, dtype=np.int64))
    # Settled windows need no key; this one spreads them.
    marks = [(hash((docs[k], places[k] + o)), None, docs[k], places[k] + o, n, False) for k, o, n in zip(*(x.tolist() for x in found), strict=True)]
    return marks, list(zip(*(x.tolist() for x in left_over(sizes - (LENGTH - 1), found)), strict=True))


def _sliced(runs: list[tuple]) -> pa.RecordBatch:
    """Pieces of runs (payload, key, doc, at, lead) of large anchors, after those that are here are refined."""
    digest = xxhash.xxh3_64_intdigest
    rows, rest = _settled(*(list(c) for c in list(zip(*runs, strict=True))[:4]))
    for k, first, count in rest:
        # Slices are aligned on the anchor: windows that start s bytes before it go by s div SLICE.
        # The bytes that all of a slice's windows hold are its key.
        payload, _, doc, at, lead = runs[k]
        for j in range((lead - first - count + 1) // SLICE, (lead - first) // SLICE + 1):
            begin = lead - SLICE * j  # of the bytes that are shared
            start, stop = max(first, begin - SLICE + 1), min(first + count - 1, begin)
            core = payload[begin : begin + LENGTH - SLICE + 1]
            rows.append((digest(core, j & 0xFFFF) - (1 << 63), payload[start : stop + LENGTH], doc, at + start, stop - start + 1, True))
    return _pieces(rows)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the runs that go on; a null payload marks windows that are settled."""
    whole, large, size = [], [], 0
    for batch in batches:
        docs, texts, lists = (batch.column(k) for k in range(3))
        for i in range(batch.num_rows):
            doc, data = docs[i].as_py(), (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
            for run in lists[i].as_py():
                at, n = run["at"], run["n"]
                if at + n - 1 + LENGTH > len(data):
                    continue  # of another text under the same id
                payload = data[at : at + n - 1 + LENGTH]
                size += len(payload)
                if run["fate"] == WHOLE:
                    whole.append((run["h"], payload, doc, at, n, False))
                else:
                    large.append((payload, run["h"], doc, at, run["lead"]))
                if size > BATCH:
                    yield _pieces(whole)
                    if large:
                        yield _sliced(large)
                    whole, large, size = [], [], 0
        tidy()
    yield _pieces(whole)
    if large:
        yield _sliced(large)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of one window each, keyed by all its bytes, of slices whose key is frequent; refined in batches first."""
    digest, held, size = xxhash.xxh3_64_intdigest, [], 0

    def out() -> pa.RecordBatch:
        payloads, keys, docs, places = (list(c) for c in zip(*held, strict=True))
        rows, rest = _settled(payloads, keys, docs, places)
        for k, first, count in rest:
            for at in range(first, first + count):
                window = payloads[k][at : at + LENGTH]
                rows.append((digest(window) - (1 << 63), window, docs[k], places[k] + at, 1, True))
        return _pieces(rows)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("payload", "key", "doc", "at")), strict=True):
            held.append(row)
            size += len(row[0])
            if size > BATCH:
                yield out()
                held, size = [], 0
        tidy()
    if held:
        yield out()


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, in the order of their keys, are refined in batches of whole keys; of a key with more than a batch, what holds a first window is carried on."""
    held: list[pa.Table] = []
    size, limit = 0, BATCH
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(_PIECES)
        held.append(table)
        size += table.column("payload").nbytes
        if size >= limit:
            table = pa.concat_tables(held).combine_chunks()
            keys = table.column("key").to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            done, _ = _equal_windows(table.slice(0, whole))
            more, firsts = _equal_windows(table.slice(whole))
            yield from done
            yield from more
            held = [firsts]
            tidy()
            size = firsts.column("payload").nbytes
            limit = max(BATCH, 2 * size)
    if held:
        yield from _equal_windows(pa.concat_tables(held).combine_chunks())[0]


_MARKS = pa.schema([("doc", pa.int64()), ("at", pa.int64()), ("n", pa.int64())])
_MARKS_DDL = "doc long, at long, n long"


def _equal_windows(table: pa.Table) -> tuple[list[pa.RecordBatch], pa.Table]:
    """Places of the windows that equal one with a smaller (doc, at), and the pieces that hold a first window."""
    if not table.num_rows:
        return [], table
    data, begins, sizes = _strings(table.column("payload").to_pylist())
    key, doc, at = (table.column(c).to_numpy() for c in ("key", "doc", "at"))
    found = repeats(data, begins, sizes, key, doc, at)
    marks = pa.RecordBatch.from_arrays([pa.array(doc[found[0]]), pa.array(at[found[0]] + found[1]), pa.array(found[2])], schema=_MARKS)
    firsts = np.unique(left_over(sizes - (LENGTH - 1), found)[0])
    return [marks], table.take(pa.array(firsts))


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place, that of the last True at or before it."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of some ranges, one range after the other."""
    return np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _buckets(values: np.ndarray) -> np.ndarray:
    """Bucket pointers: the place, in the sorted order, of the first that is equal."""
    pointer, order = np.empty(len(values), dtype=np.int64), np.argsort(values)
    sorted_ = values[order]
    pointer[order] = _starts(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))[: len(values)])
    return pointer


def same_strings(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bucket pointers of whole strings of ``data``: equal if and only if the strings are.

    Buckets of FIRST bytes, at every FIRST-th place, are refined by sorting on the pointer of the bucket behind;
    each round doubles their reach and halves their number, until one is left of each string.
    """
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    count = np.maximum(-(-sizes // FIRST), 1)
    start = np.cumsum(count) - count
    padded = np.zeros(int(count.sum()) * FIRST, dtype=np.uint8)
    padded[_ranges(start * FIRST, sizes)] = data[_ranges(begins, sizes)]
    pointer = _buckets(padded.view("<u8"))
    while count.max() > 1:
        half = (count + 1) // 2
        number = _ranges(np.zeros(len(half), dtype=np.int64), half)
        place = np.repeat(start, half) + 2 * number
        later = np.where(2 * number + 1 < np.repeat(count, half), pointer[np.minimum(place + 1, len(pointer) - 1)] + 1, 0)
        pointer = _buckets(pointer[place] * (len(pointer) + 1) + later)
        count, start = half, np.cumsum(half) - half
    # The padding is told from bytes by the size.
    return _buckets(pointer * (int(sizes.max()) + 1) + sizes)


def refine(data: np.ndarray, room: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Bucket pointers of the suffixes of ``data`` by their first ``length`` bytes.

    ``room`` has the bytes from each place to the end of its string. Suffixes with that much room
    share a pointer if and only if they agree in ``length`` bytes; the pointers of others are -1.
    """
    word, size = data.astype(np.uint64), 1
    while size < FIRST:
        word, size = (word[:-size] << np.uint64(8 * size)) | word[size:], 2 * size
    pointer = np.full(len(data), -1, dtype=np.int64)
    active = np.flatnonzero(room >= FIRST)
    pointer[active] = _buckets(word[active])
    depth = FIRST
    while depth < length:
        offset = min(depth, length - depth)
        active = np.flatnonzero(room >= depth + offset)
        own = pointer[active]
        # Only buckets of several suffixes are refined. The pointers at the later offset tell their
        # suffixes apart by the bytes from there, and the refined ones serve the next, longer offset.
        several = np.bincount(own, minlength=1)[own] > 1
        active, own = active[several], own[several]
        if not len(active):
            break
        later = pointer[active + offset]
        order = np.argsort(own * len(data) + later)
        own, later, active = own[order], later[order], active[order]
        bucket = np.concatenate(([True], own[1:] != own[:-1]))
        part = bucket | np.concatenate(([True], later[1:] != later[:-1]))
        pointer[active] = own + _starts(part) - _starts(bucket)
        depth += offset
    pointer[room < length] = -1
    return pointer


def repeats(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray, key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, windows) of all windows of LENGTH bytes that equal one with a smaller place.

    Each string of ``data`` has LENGTH bytes or more, a key, without which no windows are equal, and the place (doc, at) of
    its first window. Whole strings are refined first; of those that are equal the one with the least place goes on to
    the refinement of all windows, if another string has its key. A string at the same place is the same, from a
    repeated row of the table, and settles nothing.
    """
    none = np.zeros(0, dtype=np.int64)
    if not len(sizes):
        return none, none, none
    bucket = same_strings(data, begins, sizes)
    order = np.lexsort((at, doc, bucket))
    head = order[_starts(np.concatenate(([True], bucket[order[1:]] != bucket[order[:-1]])))]
    first = np.empty(len(sizes), dtype=np.int64)
    first[order] = head
    later = np.flatnonzero((doc != doc[first]) | (at != at[first]))
    found = [(later, np.zeros(len(later), dtype=np.int64), sizes[later] - (LENGTH - 1))]
    firsts = np.flatnonzero(first == np.arange(len(sizes)))
    _, which, count = np.unique(key[firsts], return_inverse=True, return_counts=True)
    firsts = firsts[count[which] > 1]
    if len(firsts):
        size = sizes[firsts]
        begin = np.cumsum(size) - size
        pointer = refine(data[_ranges(begins[firsts], size)], np.repeat(begin + size, size) - np.arange(size.sum()))
        window = np.flatnonzero(pointer >= 0)
        window = window[np.bincount(pointer[window])[pointer[window]] > 1]
        row = np.searchsorted(begin, window, side="right") - 1
        offset = window - begin[row]
        own_doc, own_at = doc[firsts[row]], at[firsts[row]] + offset
        order = np.lexsort((own_at, own_doc, pointer[window]))
        bucket = pointer[window][order]
        least = order[_starts(np.concatenate(([True], bucket[1:] != bucket[:-1]))[: len(bucket)])]
        later = np.zeros(len(window), dtype=bool)
        later[order] = (own_doc[order] != own_doc[least]) | (own_at[order] != own_at[least])
        row, offset = row[later], offset[later]
        new = np.flatnonzero(np.concatenate(([True], (offset[1:] != offset[:-1] + 1) | (row[1:] != row[:-1])))[: len(row)])
        found.append((firsts[row[new]], offset[new], np.diff(np.append(new, len(row)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def left_over(count: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first window, windows) of the runs that remain of strings with ``count`` windows when those of ``found`` are settled."""
    begin = np.cumsum(count) - count
    edge = np.zeros(int(count.sum()) + 1, dtype=np.int32)
    np.add.at(edge, begin[found[0]] + found[1], 1)
    np.add.at(edge, begin[found[0]] + found[1] + found[2], -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    row = np.searchsorted(begin, window, side="right") - 1
    new = np.flatnonzero(np.concatenate(([True], (window[1:] != window[:-1] + 1) | (row[1:] != row[:-1])))[: len(window)])
    return row[new], window[new] - begin[row[new]], np.diff(np.append(new, len(window)))


_RESULT = pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_RESULT_DDL = "struct<n_bytes: bigint, n_removed: bigint, n_spans: bigint, kept_sha256: string, kept: binary>"


def _remove(keep_bytes: bool):
    def run(texts: pa.Array, marks: pa.Array) -> pa.Array:
        out = []
        for text, mark in zip(texts, marks, strict=True):
            data, mark = (text.as_py() or "").encode("utf-8", "surrogatepass"), mark.values
            removed = spans = 0
            if mark is not None and len(mark):
                at, n = (mark.field(k).to_numpy() for k in (0, 1))
                edge = np.zeros(len(data) + 2, dtype=np.int32)
                np.add.at(edge, np.minimum(at, len(data)), 1)
                np.add.at(edge, np.minimum(at + n + (LENGTH - 1), len(data)), -1)
                gone = np.cumsum(edge)[: len(data)] > 0
                removed = int(np.count_nonzero(gone))
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
                size, data = len(data), np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
            else:
                size = len(data)
            out.append((size, removed, spans, hashlib.sha256(data).hexdigest(), data if keep_bytes else None))
        cols = list(zip(*out, strict=True)) or [[]] * 5
        return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _RESULT, strict=True)], fields=list(_RESULT))

    return run


def _numbered(source: DataFrame) -> DataFrame:
    """``source`` (doc_id, text) with doc, a number for each document in their order: the id, where an id has one text.

    Only where some id, or none, has several texts, all are numbered anew, by id and digest.
    """
    digest = row_key("text")
    texts = source.select("doc_id", digest.alias("digest")).groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b"))
    # The number of a null id must be nobody's id.
    if texts.where("a <> b").unionByName(texts.where(F.col("doc_id") == NULL_ID)).isEmpty():
        return source.withColumn("doc", F.coalesce("doc_id", F.lit(NULL_ID)))
    order = source.select("doc_id", digest.alias("digest")).distinct().orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    places = with_position(order, "doc").select(F.col("doc_id").alias("id"), F.col("digest").alias("of"), "doc")
    return source.join(places, F.col("doc_id").eqNullSafe(F.col("id")) & (row_key("text") == F.col("of"))).select("doc_id", "text", "doc")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_bytes: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay).

    Texts are UTF-8 bytes, a null text has none, and no match crosses documents. Every byte goes that is
    covered by a string of LENGTH bytes which also starts earlier: in a document with a smaller id, or before
    in the same; strings are judged on the input. ``kept`` is null without ``keep_bytes``; it need not
    be whole UTF-8. A null id comes after all others. Rows that repeat an id and its text are one document, each
    with the same result; texts that differ under an id, or without one, are documents of their own, in the order of their
    SHA-256. An empty table gives no rows; further columns are ignored.
    """
    ship(docs.sparkSession)
    source = _numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    anchors = materialize(source.select("doc", "text").mapInArrow(_anchors, _ANCHORS_DDL), "anchors")
    unsettled = anchors.where("h is not null")
    heavy = materialize(heavy_hitters(unsettled, "h", HEAVY, COUNTERS, LEAST), "heavy")
    light = unsettled.join(F.broadcast(heavy), "h", "left_anti").select(*_ANCHORS.names)
    light = light.repartition("h").sortWithinPartitions("h").mapInArrow(_deal, _FATES_DDL)
    sliced = unsettled.join(F.broadcast(heavy), "h").select(*_ANCHORS.names, F.lit(SLICED).cast("byte").alias("fate"))
    runs = light.unionByName(sliced).groupBy("doc").agg(F.collect_list(F.struct("at", "n", "lead", "h", "fate")).alias("runs"))
    pieces = materialize(source.join(runs.hint("shuffle_hash"), "doc").select("doc", "text", "runs").mapInArrow(_cut, _PIECES_DDL), "pieces")
    # Of the slices of one key, as of the rows of one anchor, a task gets no more than the sketch can miss.
    hot = materialize(heavy_hitters(pieces.where("sliced"), "key", HEAVY, COUNTERS, LEAST), "hot")
    open_ = pieces.where("payload is not null")
    split = open_.where("sliced").join(F.broadcast(hot), "key").select(*_PIECES.names).mapInArrow(_windows, _PIECES_DDL)
    split = materialize(split, "split")
    open_ = open_.join(F.broadcast(hot.withColumn("sliced", F.lit(True))), ["key", "sliced"], "left_anti").select(*_PIECES.names)
    meet = open_.unionByName(split.where("payload is not null")).repartition("key").sortWithinPartitions("key")
    marks = meet.mapInArrow(_grouped, _MARKS_DDL)
    for settled in (anchors.where("h is null"), pieces.where("payload is null"), split.where("payload is null")):
        marks = marks.unionByName(settled.select("doc", "at", F.col("n").cast("long").alias("n")))
    marks = materialize(marks.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("marks")), "marks")
    for table in (anchors, heavy, pieces, hot, split):
        release(table)
    remove = F.arrow_udf(_remove(keep_bytes), _RESULT_DDL)
    joined = source.join(marks.hint("shuffle_hash"), "doc", "left")
    return joined.select("doc_id", remove("text", "marks").alias("made")).select("doc_id", "made.*")
