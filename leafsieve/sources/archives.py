"""Reading books: a survey of folders, zip archives as pages, and rar or 7z archives where a tool is there."""

from __future__ import annotations

import fnmatch
import functools
import io
import os
import shutil
import subprocess
import tempfile
import zipfile
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from leafsieve.operators.pages import ARCHIVE_SUFFIXES, TEMP_PREFIX, WALKED_SUFFIXES, is_page_name, reading_order
from leafsieve.runtime import measured, ship

FILES = "archive string, size bigint, mtime_ns bigint, disposition string"
ENTRIES = "archive string, name string, size bigint, content binary, error string"


def _suffix(name: str) -> str:
    return os.path.splitext(name)[1].lower().lstrip(".")


def _is_archive(path: str, suffixes: tuple[str, ...]) -> bool:
    name = os.path.basename(path)
    return _suffix(name) in suffixes and not name.startswith(("._", TEMP_PREFIX)) and os.path.isfile(path)


def _excluded(name: str, relative: str, globs: list[str]) -> bool:
    return any(fnmatch.fnmatchcase(name, g) or fnmatch.fnmatchcase(relative, g) for g in globs)


def _judge(path: str, relative: str, suffixes: tuple[str, ...], globs: list[str]) -> str:
    """The disposition of a file."""
    if _excluded(os.path.basename(path), relative, globs):
        return "excluded" if _is_archive(path, suffixes) else "other"
    if _is_archive(path, suffixes):
        return "found"
    if _suffix(path) == "pdf":
        return "pdf"
    return "not_walked" if _is_archive(path, ARCHIVE_SUFFIXES) else "other"


def walk(paths: list[str], recursive: bool = True, exclude: list[str] = ()) -> Iterator[tuple[str, int, int, str]]:
    """(path, size, mtime in ns, disposition) of the files under some paths, each real file once.

    In a folder only suffixes that are walked count as found; a file that is named itself may be any archive
    and is tested by its name only. Links are not followed. Globs are tested against the name and the path below the folder.
    """
    globs, seen = [g.strip() for g in exclude if g.strip()], set()

    def row(path: str, what: str):
        real = os.path.realpath(path)
        if real in seen:
            return None
        seen.add(real)
        stat = os.stat(path)
        return real, stat.st_size, stat.st_mtime_ns, what

    for top in paths:
        if os.path.isfile(top):
            found = [(top, _judge(top, os.path.basename(top), ARCHIVE_SUFFIXES, globs))]
        else:
            found = []
            for folder, folders, files in os.walk(top, followlinks=False):
                folders[:] = sorted(folders) if recursive else []
                for name in sorted(files):
                    path = os.path.join(folder, name)
                    if not os.path.islink(path) or os.path.isfile(path):
                        found.append((path, _judge(path, os.path.relpath(path, top).replace(os.sep, "/"), WALKED_SUFFIXES, globs)))
        for path, what in found:
            out = row(path, what)
            if out:
                yield out


class _Tops(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class SurveySource(DataSource):
    """Format ``leafsieve-survey``: the files under ``path`` (several by newlines), a partition per path."""

    @classmethod
    def name(cls) -> str:
        return "leafsieve-survey"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SurveyReader(dict(self.options))


class _SurveyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Tops([p]) for p in self.options["path"].split("\n") if p]

    def read(self, partition: _Tops) -> Iterator[tuple]:
        recursive = self.options.get("recursive", "true").lower() != "false"
        yield from walk(partition.paths if partition else [], recursive, self.options.get("exclude", "").split("\n"))


#: Folders that a task lists below one that it is given, once there are enough for all tasks; the others go to the next round.
_LISTED = "top string, path string, size bigint, mtime_ns bigint, disposition string, task int"
BELOW, ENOUGH = 512, 4


def _list(recursive: bool, exclude: list[str], below: int):
    """Rows of the files in some folders, and, without a disposition, of folders that are still to be listed."""
    globs = [g.strip() for g in exclude if g.strip()]

    def files(top: str, folder: str, names: list[str]) -> Iterator[tuple]:
        for name in sorted(names):
            path = os.path.join(folder, name)
            try:
                if not os.path.islink(path) or os.path.isfile(path):
                    stat = os.stat(path)
                    yield top, os.path.realpath(path), stat.st_size, stat.st_mtime_ns, _judge(path, os.path.relpath(path, top).replace(os.sep, "/"), WALKED_SUFFIXES, globs)
            except OSError:  # gone since it was listed
                continue

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for top, given in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if os.path.isfile(given):  # one that is named itself
                    stat = os.stat(given)
                    rows.append((top, os.path.realpath(given), stat.st_size, stat.st_mtime_ns, _judge(given, os.path.basename(given), ARCHIVE_SUFFIXES, globs)))
                    continue
                todo, listed = deque([given]), 0
                while todo and listed < below:
                    folder, listed = todo.popleft(), listed + 1
                    _, folders, names = next(os.walk(folder, followlinks=False), (folder, [], []))
                    rows += files(top, folder, names)
                    todo.extend(p for f in sorted(folders) if recursive and not os.path.islink(p := os.path.join(folder, f)))
                rows += ((top, folder, None, None, None) for folder in todo)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
            arrays = [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([task] * len(rows), type=pa.int32())], names=[c.split()[0] for c in _LISTED.split(", ")])

    return run


def survey_rounds(spark: SparkSession, paths: list[str], recursive: bool = True, exclude: list[str] = ()) -> list[DataFrame]:
    """What each round of listing has found (top, path, size, mtime_ns, disposition, task), in tables; folders without a disposition were listed in the next.

    A round lists the folders that the last one found, dealt out evenly, so one large tree uses all tasks. Until there are some for each task,
    a round goes down one level; then each folder's task lists what is below it, up to BELOW folders.
    """
    ship(spark)
    tasks, rounds = spark.sparkContext.defaultParallelism, []
    frontier, count = spark.createDataFrame([(p, p) for p in dict.fromkeys(paths)], "top string, path string"), len(paths)
    while count:
        below = BELOW if count >= ENOUGH * tasks else 1
        found = frontier.repartition(min(tasks, count)).mapInArrow(_list(recursive, list(exclude), below), _LISTED)
        table, (count,) = measured(found, "survey", F.count_if(F.col("disposition").isNull()))
        rounds.append(table)
        frontier = table.where("disposition is null").select("top", "path")
    return rounds


def survey(spark: SparkSession, paths: list[str], recursive: bool = True, exclude: list[str] = ()) -> DataFrame:
    """(archive, size, mtime_ns, disposition) of the files under some paths, each once, in order."""
    found = spark.createDataFrame([], FILES)
    for table in survey_rounds(spark, paths, recursive, exclude):
        found = found.unionByName(table.where("disposition is not null").select(F.col("path").alias("archive"), "size", "mtime_ns", "disposition"))
    # A file reached by two paths counts once, as found if it is by either.
    rank = F.when(F.col("disposition") == "found", 0).otherwise(1)
    return found.groupBy("archive").agg(
        F.first("size").alias("size"), F.first("mtime_ns").alias("mtime_ns"), F.min_by("disposition", rank).alias("disposition")
    ).orderBy("archive")


def survey_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("disposition").agg(F.count("*").alias("files"))


#: Kinds by the first bytes, and what listing an archive is done with. Fixed values.
MAGIC = ((b"PK", "zip"), (b"Rar!", "rar"), (b"7z\xbc\xaf\x27\x1c", "7z"))
EXTRACTORS = (("7zz", "7z", "7za"), ("unrar",), ("bsdtar",))
#: Seconds after which unpacking is given up.
UNPACK_SECONDS = 600
#: Bytes of an entry that is read; a larger one is a page with an error.
MOST_BYTES = 1 << 29
_BAD_ENTRY = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, OSError)


def sniff(path: str) -> str:
    """zip, rar, 7z or unknown, by eight bytes of the file, else by its suffix."""
    try:
        with open(path, "rb") as file:
            head = file.read(8)
    except OSError:
        head = b""
    for magic, kind in MAGIC:
        if head.startswith(magic):
            return kind
    return {"cbz": "zip", "zip": "zip", "cbr": "rar", "rar": "rar", "cb7": "7z", "7z": "7z"}.get(_suffix(path), "unknown")


@functools.cache
def _reads_rar(tool: str) -> bool:
    """Whether a 7-Zip lists a codec for rar; one that lists nothing is taken to have it."""
    try:
        listed = subprocess.run([tool, "i"], capture_output=True, stdin=subprocess.DEVNULL, timeout=60, check=False).stdout.decode(errors="replace")
    except (OSError, subprocess.SubprocessError):
        return True
    _, found, codecs = listed.partition("Codecs:")
    return not found or "rar" in codecs.lower()


def extractor(kind: str = "rar", environ: str = "LEAFSIEVE_EXTRACTOR") -> list[str] | None:
    """The command that unpacks a rar or 7z archive into the present folder: one that the environment names, else the first installed that can."""
    chosen = os.environ.get(environ)
    for names in ((chosen,),) if chosen else EXTRACTORS:
        for tool in filter(None, map(shutil.which, names)):
            base = os.path.basename(tool)
            if base.startswith("bsdtar"):
                return [tool, "-xf"]
            if base.startswith("unrar"):
                if kind == "rar" or chosen:
                    return [tool, "x", "-y", "-p-"]
            elif chosen or kind != "rar" or _reads_rar(tool):
                return [tool, "x", "-y", "-p"]
    return None


def zip_entries(path: str) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(name, stored size, bytes, error) of each entry that is no folder. Of entries with one name the last counts."""
    with zipfile.ZipFile(path) as book:
        last = {info.filename: info for info in book.infolist() if not info.is_dir()}
        for name, info in last.items():
            try:
                if info.file_size > MOST_BYTES:
                    raise zipfile.BadZipFile(f"{info.file_size} bytes unpacked are more than {MOST_BYTES}")
                with book.open(info) as file:
                    data = file.read(MOST_BYTES + 1)
                if len(data) > MOST_BYTES:
                    raise zipfile.BadZipFile(f"more than {MOST_BYTES} bytes unpacked")
                yield name, info.compress_size, data, None
            except _BAD_ENTRY as failure:
                yield name, 0, None, f"{type(failure).__name__}: {failure}"


def unpacked_entries(path: str) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """Entries of a rar or 7z archive, unpacked to a folder of this task that goes at once. Links and ways out are left out."""
    tool = extractor(sniff(path))
    if tool is None:
        raise RuntimeError("no tool for rar and 7z archives is installed")
    with tempfile.TemporaryDirectory() as folder:
        done = subprocess.run([*tool, os.path.abspath(path)], cwd=folder, capture_output=True, stdin=subprocess.DEVNULL, timeout=UNPACK_SECONDS, check=False)
        if done.returncode:  # a book that is unpacked in part is not taken for a whole one
            raise RuntimeError(f"{os.path.basename(tool[0])} ended with {done.returncode}: {done.stderr.decode(errors='replace')[-200:]}")
        root, count = os.path.realpath(folder), 0
        for where, _, names in os.walk(folder):
            for name in sorted(names):
                full = os.path.join(where, name)
                if os.path.islink(full) or not os.path.realpath(full).startswith(root + os.sep):
                    continue
                count += 1
                with open(full, "rb") as file:
                    data = file.read()
                yield os.path.relpath(full, folder).replace(os.sep, "/"), len(data), data, None
        if not count:
            raise RuntimeError(f"nothing could be unpacked: {done.stderr.decode(errors='replace')[-200:]}")


def book_entries(path: str) -> Iterator[tuple[str, int, bytes | None, str | None]]:
    """(name, stored size, bytes, error) of each entry of an archive of any kind."""
    return zip_entries(path) if sniff(path) == "zip" else unpacked_entries(path)


def zip_entries_of(files: DataFrame) -> DataFrame:
    """The same of a frame of ``binaryFile`` (path, content), for archives in a store that only Spark reads."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                try:
                    rows += [(path, *entry) for entry in zip_entries(io.BytesIO(content))]
                except Exception as failure:  # one book never ends a scan
                    rows.append((path, None, 0, None, f"{type(failure).__name__}: {failure}"))
                yield pd.DataFrame(rows, columns=["archive", "name", "size", "content", "error"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, ENTRIES)


def page_entries(entries: DataFrame) -> DataFrame:
    """The pages among entries, with ``index`` in reading order; entries that can't be read count."""
    return reading_order(entries.where(F.col("name").isNotNull() & is_page_name(F.col("name"))))


def metadata_entries(entries: DataFrame) -> DataFrame:
    """(archive, xml): of each archive the first entry, by name, that is called ComicInfo.xml at any depth and in any case."""
    info = entries.where(F.lower("name").rlike(r"(^|[/\\])comicinfo\.xml$") & F.col("content").isNotNull())
    return info.groupBy("archive").agg(F.min_by("content", "name").alias("xml"))
