"""Taking runs back, and deleting their backups, in tasks.

What the files of past runs are like is looked at where they are, restores and deletions are dealt out as rows, and nothing
passes through the driver but what is shown. A restore moves one file, so it is done once even if two tasks try it: the
second finds the backup gone and the note of the first.
"""

from __future__ import annotations

import contextlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsieve.functions.text import backup_name, file_part
from leafsieve.operators import history
from leafsieve.plans import apply
from leafsieve.runtime import materialize, ship

_FACTS = "id bigint, archive_exists boolean, backup_exists boolean, output_exists boolean, size bigint, mtime_ns bigint"
_RESTORED = "id bigint, archive string, why string, restored_at double"
_DELETED = "path string, bytes bigint"


def _in_tasks(df: DataFrame, ddl: str, row: Callable[[dict], tuple | Iterator[tuple] | None], name: str) -> DataFrame:
    """A table of what ``row`` gives for each row of ``df``, once: a tuple, several, or none."""
    ship(df.sparkSession)
    schema = df.sparkSession.createDataFrame([], ddl).schema
    fields = pa.schema([(f.name, {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for given in batch.to_pylist():
                made = row(given)
                rows += [made] if isinstance(made, tuple) else made or ()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(fields)], schema=fields)

    return materialize(df.mapInArrow(run, ddl), name)


def _look(item: dict) -> tuple:
    size = mtime = None
    if item["output"]:
        try:
            found = os.stat(item["output"])
            size, mtime = found.st_size, found.st_mtime_ns
        except OSError:
            pass
    return item["id"], os.path.exists(item["archive"]), bool(item["backup"]) and os.path.exists(item["backup"]), size is not None, size, mtime


def with_status(items: DataFrame) -> DataFrame:
    """``items`` with whether their files are there and unchanged, and status."""
    seen = _in_tasks(items.select("id", "archive", "backup", "output"), _FACTS, _look, "facts")
    out = items.join(seen, "id").withColumn("unchanged", history.output_unchanged(F.col("size"), F.col("mtime_ns")))
    return out.withColumn("status", history.run_status())


def _restore(journal: str) -> Callable[[dict], tuple]:
    def row(item: dict) -> tuple:
        note = os.path.join(journal, f"restored-{item['id']}.json")
        claim = f"{note}.claim"
        while True:
            if os.path.exists(note):
                with open(note, encoding="utf-8") as file:
                    return item["id"], item["archive"], None, json.load(file)["at"]
            try:
                os.close(os.open(claim, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                break
            except FileExistsError:
                with contextlib.suppress(FileNotFoundError):
                    if time.time() - os.stat(claim).st_mtime > apply.RESTORE_LEASE:
                        apply._discard(claim)  # its task died
                time.sleep(0.1)
        try:
            if os.path.exists(note):
                with open(note, encoding="utf-8") as file:
                    return item["id"], item["archive"], None, json.load(file)["at"]
            # A task that died between moving and noting has left the book where it belongs.
            moved = item["status"] == "can be restored" and not os.path.exists(item["backup"]) and os.path.exists(item["archive"])
            why = None if moved else apply.restore(item, item["status"])
            at = time.time() if why is None else None
            if at:
                with open(f"{note}.part", "w", encoding="utf-8") as file:
                    json.dump({"at": at}, file)
                os.replace(f"{note}.part", note)
            return item["id"], item["archive"], why, at
        finally:
            apply._discard(claim)

    return row


def restore_items(items: DataFrame, journal: str, tasks: int = 4) -> DataFrame:
    """(id, archive, why, restored_at) of items with status, put back now; why is null for those that are back. ``journal`` is a folder that all machines see.

    Two restores at once that name the same journal restore each book once, and both tell so.
    """
    os.makedirs(journal, exist_ok=True)
    work = items.select("id", "archive", "output", "backup", "converted", "status").repartition(tasks, "id")
    return _in_tasks(work, _RESTORED, _restore(journal), "restored")


def mark_all_restored(items: DataFrame, restored: DataFrame) -> DataFrame:
    """``items`` with the time of those that were put back, in one pass."""
    at = restored.where("why is null").select("id", F.col("restored_at").alias("at"))
    return items.join(at, "id", "left").withColumn("restored_at", F.coalesce("at", "restored_at")).drop("at").select(*items.columns)


def find_backups(spark: SparkSession, folders: DataFrame) -> DataFrame:
    """(path, bytes) of what may be backups, directly inside ``folders`` (folder)."""

    def children(row: dict) -> Iterator[tuple]:
        try:
            with os.scandir(row["folder"]) as found:
                yield from [(e.path, e.stat().st_size) for e in found if e.is_file()]
        except OSError:
            return

    return _in_tasks(folders.select("folder").distinct(), _DELETED, children, "children").where(backup_name(file_part(F.col("path")))).distinct()


def backup_folders(items: DataFrame) -> DataFrame:
    """(folder): where backups of items can be, beside the books or where they were put."""
    paths = items.select(F.explode(F.array("archive", "backup")).alias("path")).where("path is not null")
    return paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).distinct()


def _delete(row: dict) -> tuple | None:
    try:
        size = os.path.getsize(row["path"])
        os.unlink(row["path"])
    except OSError:
        return None
    return row["path"], size


def delete_files(paths: DataFrame, tasks: int = 4) -> tuple[int, int]:
    """(files, bytes) deleted of ``paths`` (path)."""
    done = _in_tasks(paths.select("path").distinct().repartition(tasks, "path"), _DELETED, _delete, "deleted")
    return tuple(done.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first())
