"""Carrying out removal plans: each book is rebuilt beside itself, verified, and only then replaced.

A plan is one task's work and may be tried again, by a retry or by speculation; the sink
:mod:`leafsieve.sources.book_sink` sees to it that it is carried out once. Nothing is taken from a
book that is not exactly as it was scanned.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import socket
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.functions import comicinfo
from leafsieve.operators.pages import IMAGE_SUFFIXES, NO_PAGES, TEMP_PREFIX
from leafsieve.operators.removal import space_needed
from leafsieve.runtime import materialize, ship
from leafsieve.sources.archives import sniff, unpacked_entries

PENDING = ".pending"
#: In a journal: the sign that no further book is to be begun. Seconds for which another host's note is taken for that of a running task.
CANCEL, LEASE = "cancel", 6 * 3600
#: Seconds after which a claim on a restore, which is one move, is void.
RESTORE_LEASE = 3600
_CHUNK = 1 << 20
_UNSAFE = set('<>:"/|?*\\')
RESULTS = (
    "archive string, output string, backup string, removed bigint, bytes_freed bigint, converted boolean, skipped boolean, error string, quarantined array<string>"
)


class RemovalError(RuntimeError):
    """A book that is left as it is, and why."""


@dataclass(frozen=True)
class Policy:
    """Where originals go, where cleaned books go, and what else is done."""

    backups: bool = True
    backup_dir: str | None = None
    output_dir: str | None = None
    quarantine: str | None = None
    compress: bool = False
    dry_run: bool = False


@dataclass
class Result:
    archive: str
    output: str | None = None
    backup: str | None = None
    removed: int = 0
    bytes_freed: int = 0
    converted: bool = False
    skipped: bool = False
    error: str | None = None
    quarantined: list[str] = field(default_factory=list)


def is_page(name: str) -> bool:
    """The same rule as leafsieve.operators.pages.is_page_name."""
    base = name.replace("\\", "/").rpartition("/")[2]
    stem, dot, suffix = base.rpartition(".")
    return bool(base and not base.startswith(".") and base.lower() not in NO_PAGES and "__MACOSX" not in name and stem and dot and suffix.lower() in IMAGE_SUFFIXES)


def natural(name: str) -> list[tuple[int, int, str]]:
    """The same order as leafsieve.functions.text.natural_key."""
    out, part, digits = [], "", False
    for c in f"{name.lower()}\0":
        number = c in "0123456789"
        if c == "\0" or number != digits:
            plain = part.lstrip("0") or part[-1:]
            out.append((1, len(plain), plain) if digits else (0, 0, part))
            part, digits = "", number
        part += c
    return out


def safe_name(name: str) -> str:
    base = name.replace("\\", "/").rpartition("/")[2]
    return "".join("_" if c in _UNSAFE or ord(c) < 32 else c for c in base).strip(" .") or "page"


class _Book:
    """Entries of an archive: names in order, bytes, stored sizes, dates (of a zip)."""

    def __init__(self, path: str):
        self.zip = zipfile.ZipFile(path) if sniff(path) == "zip" else None
        if self.zip:
            self.info = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}
            self.names = list(self.info)
        else:
            self.data = {n: d for n, _, d, _ in unpacked_entries(path)}
            self.names = list(self.data)

    def __enter__(self) -> _Book:
        return self

    def __exit__(self, *_: object) -> None:
        if self.zip:
            self.zip.close()

    def open(self, name: str):
        import io

        return self.zip.open(self.info[name]) if self.zip else io.BytesIO(self.data[name])

    def stored(self, name: str) -> int:
        return self.info[name].compress_size if self.zip else len(self.data[name])

    def date(self, name: str) -> tuple:
        return self.info[name].date_time if self.zip else (1980, 1, 1, 0, 0, 0)


def _sha(book: _Book, name: str) -> str:
    digest = hashlib.sha256()
    with book.open(name) as file:
        while block := file.read(_CHUNK):
            digest.update(block)
    return digest.hexdigest()


def _check(book: _Book, removed: list[dict]) -> tuple[list[str], list[str]]:
    """(pages in reading order, names that go), if the plan still fits the book."""
    pages = sorted((n for n in book.names if is_page(n)), key=lambda n: (natural(n), n))
    wanted = {r["name"]: r["content_sha"] for r in removed}
    missing = sorted(set(wanted) - set(pages))
    if missing:
        raise RemovalError(f"the book has changed since it was scanned: {len(missing)} page(s) such as {missing[0]} are not there")
    for name, sha in sorted(wanted.items()):
        if not sha:
            raise RemovalError(f"{name} has no digest to be told by; nothing was removed")
        if _sha(book, name) != sha:
            raise RemovalError(f"the book has changed since it was scanned: {name} is another page now")
    if len(wanted) == len(pages):
        raise RemovalError("this would leave no page; nothing was removed")
    return pages, [n for n in pages if n in wanted]


def _rebuild(book: _Book, target: str, pages: list[str], gone: list[str], compress: bool) -> None:
    """Entries but those that go, in order; pictures are stored, documents are packed."""
    info = next((n for n in book.names if n.replace("\\", "/").rpartition("/")[2].lower() == "comicinfo.xml"), None)
    drop, places = set(gone), {n: i for i, n in enumerate(pages)}
    with zipfile.ZipFile(target, "w") as out:
        for name in book.names:
            if name in drop:
                continue
            entry = zipfile.ZipInfo(name, date_time=book.date(name))
            entry.compress_type = zipfile.ZIP_DEFLATED if compress or name.lower().endswith(".xml") else zipfile.ZIP_STORED
            with book.open(name) as source:
                if name == info:
                    out.writestr(entry, comicinfo.update(source.read(), {places[n] for n in gone}, len(pages) - len(gone)))
                else:
                    with out.open(entry, "w", force_zip64=True) as file:
                        shutil.copyfileobj(source, file, _CHUNK)


def verify(path: str, pages: int) -> None:
    """Every entry reads back, and the number of pages is right."""
    with zipfile.ZipFile(path) as book:
        bad = book.testzip()
        found = sum(map(is_page, book.namelist()))
    if bad or found != pages:
        raise RemovalError(f"the rebuilt book is damaged: {bad or f'{found} pages, not {pages}'}")


def backup_path(archive: str, folder: str | None) -> str:
    """A name that is free: with .bak, then .bak.1 and so on."""
    plain = os.path.join(folder or os.path.dirname(archive), os.path.basename(archive) + ".bak")
    path, number = plain, 0
    while os.path.lexists(path):
        number += 1
        path = f"{plain}.{number}"
    return path


def _move(source: str, target: str) -> None:
    """A rename; to another volume a copy that is complete before the source goes."""
    try:
        os.rename(source, target)
    except OSError:
        part = f"{target}{TEMP_PREFIX}part"
        shutil.copy2(source, part)
        os.replace(part, target)
        os.unlink(source)


def _quarantine(book: _Book, names: list[str], folder: str, stem: str) -> Iterator[str]:
    """Copies of pages, never over another file."""
    place = os.path.join(folder, safe_name(stem))
    os.makedirs(place, exist_ok=True)
    for name in names:
        base, suffix = os.path.splitext(safe_name(name))
        path, number = os.path.join(place, base + suffix), 0
        while os.path.lexists(path):
            number += 1
            path = os.path.join(place, f"{base}-{number}{suffix}")
        with open(path, "xb") as file, book.open(name) as source:
            yield path
            shutil.copyfileobj(source, file, _CHUNK)


def _discard(*paths: str | None) -> None:
    for path in paths:
        if path:
            with contextlib.suppress(OSError):
                os.unlink(path)


def carry_out(archive: str, removed: list[dict], policy: Policy, key: str, tell: Callable[[dict], None] = lambda last: None) -> Result:
    """Rebuild one book without its marked pages. A failure leaves the book as it was.

    ``tell`` is told, before anything is moved, what is about to be done, and by which size and time the rebuilt book can be known.
    """
    result = Result(archive)
    if not removed:
        result.skipped = True
        return result
    converted = sniff(archive) in ("rar", "7z")
    output = os.path.join(policy.output_dir or os.path.dirname(archive), os.path.basename(archive))
    output = os.path.splitext(output)[0] + ".cbz" if converted else output
    temp, marker, backup = os.path.join(os.path.dirname(output), f"{TEMP_PREFIX}{key}.cbz"), None, None
    try:
        with _Book(archive) as book:
            pages, gone = _check(book, removed)
            result.removed, result.bytes_freed = len(gone), sum(map(book.stored, gone))
            result.output, result.converted = output, converted
            if os.path.lexists(output) and (policy.output_dir or output != archive):
                raise RemovalError(f"{os.path.basename(output)} is there already and is not written over")
            if policy.dry_run:
                return result
            os.makedirs(os.path.dirname(output), exist_ok=True)
            _discard(temp)
            _rebuild(book, temp, pages, gone, policy.compress)
            if policy.quarantine:
                for copy in _quarantine(book, gone, policy.quarantine, os.path.splitext(os.path.basename(archive))[0]):
                    result.quarantined.append(copy)
        verify(temp, len(pages) - len(gone))
        shutil.copymode(archive, temp)
        if policy.output_dir is None and policy.backups:
            if policy.backup_dir:
                os.makedirs(policy.backup_dir, exist_ok=True)
            backup = backup_path(archive, policy.backup_dir)
        result.backup, stat = backup, os.stat(temp)
        marked = temp.removesuffix(".cbz") + PENDING if backup else None
        tell({"archive": archive, "output": output, "backup": backup, "temp": temp, "marker": marked, "stat": [stat.st_size, stat.st_mtime_ns], "result": asdict(result)})
        if backup:
            marker = temp.removesuffix(".cbz") + PENDING
            with open(marker, "w", encoding="utf-8") as file:
                json.dump({"original": archive, "output": output, "backup": backup, "temp": temp, "pid": os.getpid(), "host": socket.gethostname()}, file)
            _move(archive, backup)
        os.replace(temp, output)
        _discard(marker)
        if policy.output_dir is None and not policy.backups and output != archive:
            _discard(archive)
    except Exception as failure:  # whatever it was, the book is put back and the others go on
        _discard(temp, *result.quarantined)
        if backup and os.path.exists(backup) and not os.path.exists(archive):
            _move(backup, archive)
        _discard(marker)
        return Result(archive, error=str(failure) or type(failure).__name__)
    return result


def plan_key(archive: str, removed: list[dict]) -> str:
    return hashlib.sha256(json.dumps([archive, sorted([r["name"], r["content_sha"]] for r in removed)]).encode()).hexdigest()[:32]


def apply_removals(plans: DataFrame, policy: Policy, journal: str, tasks: int = 4, root: str | None = None) -> DataFrame:
    """The results of plans (archive, removed), carried out now. ``journal`` is a folder for this run that all machines see.

    Few tasks work at once, since disks are the limit. Under an output folder, folders below ``root`` are mirrored. A run that ended before its end
    goes on where it is called again with the same folder.
    """
    from leafsieve.sources.book_sink import BookSink, committed_results

    spark = plans.sparkSession
    ship(spark)
    spark.dataSource.register(BookSink)
    os.makedirs(journal, exist_ok=True)
    work = plans.select("archive", "removed").repartition(tasks, "archive")
    options = {"journal": journal, "policy": json.dumps(asdict(policy))} | ({"root": root} if root else {})
    work.write.format(BookSink.name()).options(**options).mode("append").save()
    return materialize(committed_results(spark, journal), "results")


def cancel(journal: str) -> None:
    """No further book of the run is begun; those that are being worked on are finished."""
    with open(os.path.join(journal, CANCEL), "w", encoding="utf-8"):
        pass


def progress(journal: str) -> int:
    """Books of a run that are done."""
    return sum(n.endswith(".json") and n != "committed.json" for n in os.listdir(journal)) if os.path.isdir(journal) else 0


def _mount(path: str) -> str:
    """The volume that holds a path, or its nearest folder that exists: where it is mounted."""
    path = os.path.abspath(path)
    while not os.path.exists(path) or not os.path.ismount(path):
        path = os.path.dirname(path)
    return path


def _look(batches):
    import pandas as pd

    for batch in batches:
        rows = []
        for archive in batch["archive"]:
            try:
                rows.append((archive, os.path.getsize(archive), _mount(archive), shutil.disk_usage(_mount(archive)).free, sniff(archive)))
            except OSError:
                rows.append((archive, 0, _mount(archive), 0, sniff(archive)))
        yield pd.DataFrame(rows, columns=["archive", "size", "volume", "free", "kind"])


def look_at(plans: DataFrame) -> DataFrame:
    """(archive, size, volume, free, kind) of the books of plans, looked at where they will be worked on."""
    ship(plans.sparkSession)
    return materialize(plans.select("archive").mapInPandas(_look, "archive string, size bigint, volume string, free bigint, kind string"), "looked")


def shortfall(plans: DataFrame, looked: DataFrame, policy: Policy) -> DataFrame:
    """(volume, needed, free) of the volumes that can't hold what a run writes; no rows let it begin."""
    folders = [f for f in (policy.backup_dir, policy.output_dir) if f]
    own = [(_mount(f), shutil.disk_usage(_mount(f)).free) for f in folders]
    free = looked.where("size > 0").groupBy("volume").agg(F.min("free").alias("free"))
    free = free.unionByName(plans.sparkSession.createDataFrame(own, "volume string, free bigint")).groupBy("volume").agg(F.min("free").alias("free"))
    return space_needed(
        plans, looked.select("archive", "size", "volume"), free, _mount(policy.backup_dir) if policy.backup_dir else None,
        _mount(policy.output_dir) if policy.output_dir else None, policy.backups,
    )


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except OSError:
        return True
    return True


def recover(folders: list[str], dry_run: bool = False) -> list[tuple[str, str, bool]]:
    """(original, backup, put back) of runs that ended between moving a book aside and replacing it.

    Only books with a note are touched, and none whose process is still there. What runs on another host can't be
    asked: there a note counts as good for LEASE seconds.
    """
    out, here = [], socket.gethostname()
    for top in folders:
        for folder, _, names in os.walk(top):
            for name in sorted(n for n in names if n.startswith(TEMP_PREFIX) and n.endswith(PENDING)):
                marker = os.path.join(folder, name)
                try:
                    with open(marker, encoding="utf-8") as file:
                        note = json.load(file)
                    original, output, backup, temp = (str(note[k]) for k in ("original", "output", "backup", "temp"))
                    running = _alive(int(note["pid"])) if note.get("host", here) == here else time.time() - os.path.getmtime(marker) < LEASE
                except (OSError, ValueError, KeyError, TypeError):
                    continue
                back = not os.path.exists(original) and not os.path.exists(output)
                if running or (back and not os.path.exists(backup)):
                    continue
                if not dry_run:
                    if back:
                        _move(backup, original)
                    if os.path.basename(temp).startswith(TEMP_PREFIX):
                        _discard(temp)
                    _discard(marker)
                out.append((original, backup, back))
    return out


def restore(item: dict, status: str) -> str | None:
    """Put a book back as it was before a run; the reason if that can't be."""
    if status != "can be restored":
        return status
    try:
        _move(item["backup"], item["archive"])
        if item["converted"] and item["output"] != item["archive"]:
            _discard(item["output"])
    except OSError as failure:
        return str(failure)
    return None


def delete_backups(paths: list[str], pinned: bool = False) -> tuple[int, int]:
    """(files, bytes) deleted of the backups of a run; a pinned run's are refused."""
    if pinned:
        raise ValueError("the run is pinned")
    count = size = 0
    for path in paths:
        with contextlib.suppress(OSError):
            own = os.path.getsize(path)
            os.unlink(path)
            count, size = count + 1, size + own
    return count, size
