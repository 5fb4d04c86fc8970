"""Token ids in flat binary files that are memory-mapped.

A folder holds shards and ``index.json``. Of each shard there are three files without any header, little-endian:

* ``.ids``: the ids of its documents, one after the other, as unsigned integers of 16 bits if the vocabulary fits, else of 32;
* ``.offsets``: the place of each document's first id in ``.ids``, and the end, as 64-bit integers;
* ``.docs``: the documents' own ids, as signed 64-bit integers; those without one come first and are counted in the index.

Shards are ranges of documents in ascending order. Their places in the whole are prefix sums over the sizes that their
tasks report, so no task waits for another. An attempt of a task writes files of its own, and only those whose attempt has
succeeded get into the index: lost executors and tasks run twice leave nothing but files that the index does not name.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from leafsieve.llm.textwork import slices, tidy
from leafsieve.llm.word_ids import encoder
from leafsieve.runtime import materialize, release, ship

#: The id that ends a document.
END = 1
#: Ids that are read from a shard at once; a longer document is read alone.
AT_ONCE = 1 << 20
INDEX = "index.json"

_DONE = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("nulls", pa.int64())])
_DONE_DDL = "part int, name string, docs long, ids long, nulls long"
_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _folder(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _write_shard(tokenizer_path: str, path: str, end: int, width: int):
    """A task's documents as a shard, and a row that reports it; a task without documents writes nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer_path).encode
        name, stop = f"{part:07d}-{uuid.uuid4().hex}", np.array([end], dtype="<u4").tobytes()
        files, docs, ids, nulls, (fs, top) = None, 0, 0, 0, _folder(path)
        try:
            for batch in batches:
                keys = batch.column(0)
                nulls += keys.null_count
                for first, held in slices(batch.column(1).cast(pa.binary()).to_pylist()):
                    if files is None:
                        files = [fs.open_output_stream(f"{top}/{name}.{kind}") for kind in ("ids", "offsets", "docs")]
                        files[1].write(bytes(8))
                    found = encode(held)
                    ends = ids + np.cumsum(np.fromiter((len(f) // 4 + 1 for f in found), dtype="<i8", count=len(found)))
                    flat = np.frombuffer(stop.join([*found, b""]), dtype="<u4")
                    files[0].write(flat.astype(f"<u{width}").tobytes())
                    files[1].write(ends.astype("<i8").tobytes())
                    files[2].write(keys.slice(first, len(held)).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    docs, ids = docs + len(found), int(ends[-1])
                tidy()
        finally:
            for file in files or ():
                file.close()
        if docs:
            yield pa.RecordBatch.from_pylist([{"part": part, "name": name, "docs": docs, "ids": ids, "nulls": nulls}], schema=_DONE)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> str:
    """Write the ids of every whole text, each text ended by ``end``, to a folder that driver and executors share; returns it.

    Documents are in ascending order of their ids, which are cast to long; null ids come first, and rows of one id are in
    the order of a hash of their text, and of the text. Null and empty texts have the end id alone, repeated rows are written as they
    come, further columns are ignored, and an empty table makes an index without shards. The folder is a URI that Arrow knows
    (file, hdfs, s3, gs) or a local path, and may be there already. A written index is taken back only by a new one, which is put in its place
    at the end; files that it does not name are deleted.

    Texts are dealt out by ranges of id and hash, so ids that come very often are split as well. What the driver gets is a row per shard.
    """
    ship(docs.sparkSession)
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    width = 2 if max(size, end + 1) <= 1 << 16 else 4
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    fs, top = _folder(path)
    fs.create_dir(top)
    done = materialize(dealt.mapInArrow(_write_shard(tokenizer_path, path, end, width), _DONE_DDL), "shards")
    shards = [r.asDict() for r in done.orderBy("part").collect()]
    release(done)
    for what in ("docs", "ids"):
        for shard, before in zip(shards, accumulate((s[what] for s in shards), initial=0), strict=False):
            shard[f"{what}_before"] = before
    made = f"{top}/{INDEX}-{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as out:
        out.write(json.dumps({"width": width, "end": end, "shards": shards}).encode())
    fs.move(made, f"{top}/{INDEX}")
    named = {s["name"] for s in shards}
    for entry in fs.get_file_info(arrow_fs.FileSelector(top)):
        stem, _, kind = entry.base_name.rpartition(".")
        if kind in ("ids", "offsets", "docs") and stem not in named:
            fs.delete_file(entry.path)
    return path


def read_index(path: str) -> dict:
    fs, top = _folder(path)
    with fs.open_input_stream(f"{top}/{INDEX}") as file:
        return json.loads(file.read())


class Shard:
    """The files of a shard, mapped into memory where they are local, else read piece by piece."""

    def __init__(self, path: str, index: dict, shard: dict):
        fs, top = _folder(path)
        self.about, kinds = shard, {"ids": f"<u{index['width']}", "offsets": "<i8", "docs": "<i8"}
        self.parts = {}
        for kind, dtype in kinds.items():
            name = f"{top}/{shard['name']}.{kind}"
            local = isinstance(fs, arrow_fs.LocalFileSystem)
            self.parts[kind] = np.memmap(name, dtype=dtype, mode="r") if local else _Remote(fs.open_input_file(name), np.dtype(dtype))
        if len(self.parts["ids"]) != shard["ids"] or len(self.parts["docs"]) != shard["docs"]:
            raise ValueError(f"{path}: {shard['name']} is not as long as the index says")

    def ids(self, first: int, stop: int) -> np.ndarray:
        return self.parts["ids"][first:stop]

    def offsets(self, first: int, stop: int) -> np.ndarray:
        """Where documents ``first`` to ``stop`` begin."""
        return self.parts["offsets"][first : stop + 1]

    def docs(self, first: int, stop: int) -> list[int | None]:
        found = np.asarray(self.parts["docs"][first:stop]).tolist()
        return [None] * min(max(self.about["nulls"] - first, 0), len(found)) + found[max(self.about["nulls"] - first, 0) :]


class _Remote:
    """Numbers of a file that can't be mapped."""

    def __init__(self, file: pa.NativeFile, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        first, stop, _ = part.indices(len(self))
        return np.frombuffer(self.file.read_at((stop - first) * self.dtype.itemsize, first * self.dtype.itemsize), dtype=self.dtype)


class TokenFiles:
    """A written folder as one long run of ids, for training loops: any document, or any stretch of ids, without reading the rest."""

    def __init__(self, path: str):
        self.path, self.index = path, read_index(path)
        self.shards = self.index["shards"]
        self.docs_before = [s["docs_before"] for s in self.shards]
        self.ids_before = [s["ids_before"] for s in self.shards]
        self._open: dict[int, Shard] = {}

    def _shard(self, k: int) -> Shard:
        if k not in self._open:
            self._open[k] = Shard(self.path, self.index, self.shards[k])
        return self._open[k]

    def __len__(self) -> int:
        return self.docs_before[-1] + self.shards[-1]["docs"] if self.shards else 0

    @property
    def n_ids(self) -> int:
        return self.ids_before[-1] + self.shards[-1]["ids"] if self.shards else 0

    def __getitem__(self, k: int) -> np.ndarray:
        """The ids of the k-th document, with the end id."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = bisect_right(self.docs_before, k) - 1
        shard, k = self._shard(at), k - self.docs_before[at]
        return shard.ids(*map(int, shard.offsets(k, k + 1)))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place ``start`` to ``stop`` of all, which may lie in several shards."""
        start, stop, parts = max(start, 0), min(stop, self.n_ids), []
        while start < stop:
            at = bisect_right(self.ids_before, start) - 1
            first = start - self.ids_before[at]
            parts.append(self._shard(at).ids(first, min(stop - self.ids_before[at], self.shards[at]["ids"])))
            start += len(parts[-1])
        return np.concatenate(parts) if parts else np.zeros(0, dtype=f"<u{self.index['width']}")


@dataclass
class _Part(InputPartition):
    index: dict
    shard: dict


class TokenSource(DataSource):
    """A written folder as a table with a row per document; a task reads a shard."""

    @classmethod
    def name(cls) -> str:
        return "leafsieve-tokens"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return _TokenReader(self.options["path"])


class _TokenReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        index = read_index(self.path)
        about = {k: v for k, v in index.items() if k != "shards"}
        return [_Part(about, s) for s in index["shards"]] or [_Part(about, {})]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.shard:
            return
        shard, before, docs = Shard(self.path, partition.index, partition.shard), partition.shard["ids_before"], partition.shard["docs"]
        first = 0
        while first < docs:
            # As many documents as have AT_ONCE ids, but one at least.
            ends = shard.offsets(first, min(first + (1 << 16), docs))
            n = max(1, int(np.searchsorted(ends, ends[0] + AT_ONCE, side="right")) - 1)
            ends = np.asarray(ends[: n + 1])
            data = shard.ids(int(ends[0]), int(ends[-1])).astype("<u4").tobytes()
            cuts = 4 * (ends - ends[0])
            offsets = pa.py_buffer(cuts.astype("<i8").tobytes())
            ids = pa.Array.from_buffers(pa.large_binary(), n, [None, offsets, pa.py_buffer(data)]).cast(pa.binary())
            columns = [pa.array(shard.docs(first, first + n), type=pa.int64()), pa.array(before + ends[:-1]), pa.array(np.diff(ends)), ids]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)
            first += n


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row per document of a folder written by :func:`write_tokens`: doc_id, start (ids of all documents before it), n_tokens, and
    ids as little-endian unsigned 32-bit integers, end id included. An index without shards gives no rows."""
    ship(spark)
    spark.dataSource.register(TokenSource)
    return spark.read.format(TokenSource.name()).option("path", path).load()
