"""From folders to tables: books and pages, read anew only where they have changed."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsieve.functions.imaging import codec_fingerprint, digest
from leafsieve.operators.incremental import adopt_moved, cache_misses, stale_errors
from leafsieve.operators.pages import read_metadata
from leafsieve.plans.apply import is_page, natural
from leafsieve.plans.progress import Watch
from leafsieve.runtime import materialize, ship
from leafsieve.sources.archives import book_entries, survey

PAGES = (
    "archive string, name string, index int, size bigint, width int, height int, content_sha string, dhash bigint, flat boolean, error string, codecs string"
)
BOOKS = "archive string, size bigint, mtime_ns bigint, page_count int, error string, series string, number string, title string"


#: Bytes of books that a task reads, a larger book by itself.
TASK_BYTES = 32 << 20
_READ = "archive string, name string, index int, size bigint, width int, height int, content_sha string, dhash bigint, flat boolean, error string, xml binary"


def _digest_book(path: str) -> list[tuple]:
    """A row per page of a book, in reading order, and one of the book without a name: its error and its metadata. Pictures are looked at one after the other, and none is kept."""
    pages, info, error = [], None, None
    try:
        for name, size, data, failure in book_entries(path):
            if is_page(name):
                width, height, dhash, flat, wrong = digest(data)
                wrong = failure or wrong
                pages.append((name, size, width, height, "" if wrong else hashlib.sha256(data).hexdigest(), dhash, flat, wrong))
            elif data is not None and name.replace("\\", "/").rpartition("/")[2].lower() == "comicinfo.xml" and (info is None or name < info[0]):
                info = name, data
    except Exception as failure:  # one book never ends a scan
        error = f"{type(failure).__name__}: {failure}"
    pages.sort(key=lambda p: (natural(p[0]), p[0]))
    rows = [(path, p[0], i, *p[1:], None) for i, p in enumerate(pages)]
    return [*rows, (path, None, None, None, None, None, None, None, None, error, info[1] if info else None)]


def _digest_books(count: Callable[[int], None]):
    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, size in zip(batch["archive"], batch["size"], strict=True):
                rows = pd.DataFrame(_digest_book(path), columns=[c.split()[0] for c in _READ.split(", ")])
                count(int(size))
                yield rows.astype({c: "Int64" for c in ("index", "size", "width", "height", "dhash")} | {"flat": "boolean"})

    return run


def _still_there(batches):
    for batch in batches:
        paths = batch.column(0)
        yield pa.RecordBatch.from_arrays([paths, pa.array([os.path.exists(p) for p in paths.to_pylist()])], names=["archive", "there"])


@dataclass(frozen=True)
class Changes:
    """What a scan has found: all books there are, the rows of those that are new or under another path, and paths that hold a book no more."""

    files: DataFrame
    books: DataFrame
    pages: DataFrame
    gone: DataFrame
    kept: DataFrame


def scan_changes(spark: SparkSession, paths: list[str], cached: tuple[DataFrame, DataFrame] | None = None, exclude: list[str] = (), watch: Watch | None = None) -> Changes:
    """The books under some paths, and the rows by which they differ from ``cached``.

    Of ``cached``, books whose size and time stand are not read again, unless a page of theirs failed with
    other decoders than the present ones; nor is a book that is exactly one cached book under another path. A book's pages
    are numbered and digested in the task that reads it; no picture leaves that. ``kept`` (archive) are the books whose
    cached rows stand. A ``watch`` is told of the progress, and can stop the reading, which raises Cancelled.
    """
    ship(spark)
    watch = watch or Watch(spark)
    codecs = codec_fingerprint()
    files = materialize(survey(spark, paths, exclude=exclude).where("disposition = 'found'").drop("disposition"), "files")
    old_books, old_pages = cached or (spark.createDataFrame([], BOOKS), spark.createDataFrame([], PAGES))
    stale = stale_errors(old_pages, codecs).select("archive").distinct()
    good = old_books.join(stale, "archive", "left_anti")
    misses = materialize(cache_misses(files, good), "misses")
    moved = materialize(adopt_moved(misses, good), "moved")
    todo = materialize(misses.join(moved.select("archive"), "archive", "left_anti"), "todo")
    count, size = todo.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    dealt = todo.select("archive", "size").repartition(-(-size // TASK_BYTES) + 1, "archive")
    with watch.reading(count, size):
        read = materialize(dealt.mapInPandas(_digest_books(watch.counter()), _READ), "read")
    new_pages = read.where("name is not null").drop("xml").withColumn("codecs", F.lit(codecs))
    heads = read_metadata(read.where("name is null").select("archive", "error", "xml"), "xml").select("archive", "error", "series", "number", "title")
    counts = new_pages.groupBy("archive").agg(F.count("*").cast("int").alias("page_count"))
    new_books = todo.join(counts, "archive", "left").join(heads, "archive", "left").select(
        "archive", "size", "mtime_ns", F.coalesce("page_count", F.lit(0)).alias("page_count"), "error",
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("series", "number", "title")),
    )

    def elsewhere(table: DataFrame, like: DataFrame) -> DataFrame:
        return table.withColumnRenamed("archive", "old").join(moved, "old").drop("old").select(*like.columns)

    # A book that was copied stays under its old path as well.
    seen = moved.select(F.col("old").alias("archive")).mapInArrow(_still_there, "archive string, there boolean")
    return Changes(
        files, materialize(elsewhere(old_books, new_books).unionByName(new_books), "new-books"), materialize(elsewhere(old_pages, new_pages).unionByName(new_pages), "new-pages"),
        seen.where("not there").select("archive"), files.join(misses.select("archive"), "archive", "left_anti").select("archive"),
    )


def scan(
    spark: SparkSession, paths: list[str], cached: tuple[DataFrame, DataFrame] | None = None, exclude: list[str] = (), watch: Watch | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(archives, pages) of the books under some paths, as :func:`scan_changes` finds them and as they are in ``cached``."""
    new = scan_changes(spark, paths, cached, exclude, watch)

    def whole(fresh: DataFrame, old: DataFrame | None) -> DataFrame:
        return fresh if old is None else old.join(new.kept, "archive", "left_semi").select(*fresh.columns).unionByName(fresh)

    old_books, old_pages = cached or (None, None)
    return materialize(whole(new.books, old_books), "books"), materialize(whole(new.pages, old_pages), "pages")
