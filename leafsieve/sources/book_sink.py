"""Carrying out removal plans as a sink: ``df.write.format("leafsieve-apply")``.

A plan is claimed before it is begun, by creating a file that only one attempt can create. A second attempt, by speculation
or a retry, waits for the first one's result and hands that on, so no plan is carried out twice. Who works on a plan keeps
its claim fresh; a claim whose owner is dead is taken over, after what the owner has left is settled: a book that had been replaced is
noted as done, one that had been moved aside is put back. Tasks write their results to files of their own, and the commit, which has a
message per task, names the files of the attempts that succeeded. An abort takes nothing back: books that are done stay done, and the
next run in the same folder finds their results.
"""

from __future__ import annotations

import contextlib
import json
import os
import socket
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from leafsieve.plans import apply

#: Seconds after which a claim of another machine that was not kept fresh is void, between two signs of life, and between looks at a claim.
LEASE, BEAT, LOOK = 60.0, 10.0, 0.2
COMMITTED, FILES = "committed.json", "results"

#: Claims that this process is working on.
_active: set[str] = set()


def _started(pid: int) -> str | None:
    """When a process began, where that can be told; its number alone may be another's by now."""
    try:
        with open(f"/proc/{pid}/stat", encoding="utf-8") as file:
            return file.read().rpartition(")")[2].split()[19]
    except (OSError, IndexError):
        return None


def _write(path: str, what: dict) -> None:
    """In place at once."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with open(part, "w", encoding="utf-8") as file:
        json.dump(what, file)
    os.replace(part, path)


def _read(path: str) -> dict | None:
    try:
        with open(path, encoding="utf-8") as file:
            return json.load(file)
    except (OSError, ValueError):
        return None


def _age(path: str) -> float:
    """Seconds since a file was touched, by the clock of its file system."""
    probe = f"{path}.{uuid.uuid4().hex}.probe"
    with open(probe, "w", encoding="utf-8"):
        pass
    try:
        return os.stat(probe).st_mtime - os.stat(path).st_mtime
    finally:
        os.unlink(probe)


def _is_running(claim: str, owner: dict | None) -> bool:
    if owner and owner["host"] == socket.gethostname():
        if owner["pid"] == os.getpid():
            return owner["token"] in _active
        return apply._alive(owner["pid"]) and _started(owner["pid"]) == owner["started"]
    try:
        return _age(claim) < LEASE  # on another machine, or not written yet
    except FileNotFoundError:
        return True  # just ended: look again


def _stat(path: str) -> list[int] | None:
    with contextlib.suppress(OSError):
        found = os.stat(path)
        return [found.st_size, found.st_mtime_ns]
    return None


def _settle(owner: dict | None, note: str) -> None:
    """Bring the book of a dead owner to one state or the other."""
    last = (owner or {}).get("last")
    if not last:
        return
    if _stat(last["output"]) == last["stat"]:  # replaced, but not noted
        _write(note, last["result"])
    elif last["backup"] and os.path.exists(last["backup"]) and not os.path.exists(last["archive"]):
        apply._move(last["backup"], last["archive"])
    apply._discard(last["temp"], last["marker"])


class _Beat:
    """Keeps a claim fresh while a book is worked on."""

    def __init__(self, claim: str):
        self.claim, self.ended = claim, threading.Event()
        self.thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self.ended.wait(BEAT):
            with contextlib.suppress(OSError):
                os.utime(self.claim)

    def __enter__(self) -> _Beat:
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.ended.set()


def carry_out_once(archive: str, pages: list[dict], policy: apply.Policy, journal: str) -> dict:
    """The result of a plan, which is carried out here, or was or is by another attempt."""
    key = apply.plan_key(archive, pages)
    note, claim = os.path.join(journal, f"{key}.json"), os.path.join(journal, f"{key}.claim")
    owner = {"host": socket.gethostname(), "pid": os.getpid(), "started": _started(os.getpid()), "token": uuid.uuid4().hex}
    while True:
        if done := _read(note):
            return done
        if os.path.exists(os.path.join(journal, apply.CANCEL)):
            return asdict(apply.Result(archive, skipped=True, error="cancelled before this book"))
        try:
            os.close(os.open(claim, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            there = _read(claim)
            if _is_running(claim, there):
                time.sleep(LOOK)
                continue
            dead = f"{claim}.{owner['token']}"
            with contextlib.suppress(FileNotFoundError):  # another attempt was faster
                os.rename(claim, dead)
                _settle(_read(dead), note)
                os.unlink(dead)
            continue
        if os.path.exists(note):  # noted between the look and the claim
            apply._discard(claim)
            continue
        break
    _active.add(owner["token"])
    try:
        _write(claim, owner)
        with _Beat(claim):
            done = asdict(apply.carry_out(archive, pages, policy, key, lambda last: _write(claim, owner | {"last": last})))
        if not policy.dry_run:
            _write(note, done)
        return done
    finally:
        _active.discard(owner["token"])
        apply._discard(claim)


@dataclass
class Written(WriterCommitMessage):
    """The results of a task: their file, and how many they are."""

    file: str | None
    books: int


class BookSink(DataSource):
    """Format ``leafsieve-apply``: rows (archive, removed) are plans. Options: journal (a folder that all see), policy (as JSON), root."""

    @classmethod
    def name(cls) -> str:
        return "leafsieve-apply"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(dict(self.options))


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.journal, self.root = options["journal"], options.get("root")
        self.policy = json.loads(options["policy"])

    def write(self, iterator: Iterator) -> Written:
        name, books, policy = f"{uuid.uuid4().hex}.jsonl", 0, self.policy
        os.makedirs(os.path.join(self.journal, FILES), exist_ok=True)
        with open(os.path.join(self.journal, FILES, name), "w", encoding="utf-8") as file:
            for row in iterator:
                if self.policy["output_dir"] and self.root:  # folders are mirrored, so books of one name don't meet
                    below = os.path.relpath(os.path.dirname(row.archive), self.root)
                    policy = self.policy | {"output_dir": os.path.join(self.policy["output_dir"], below)}
                pages = [r.asDict() for r in row.removed or ()]
                file.write(json.dumps(carry_out_once(row.archive, pages, apply.Policy(**policy), self.journal)) + "\n")
                books += 1
        return Written(name, books)

    def commit(self, messages: list[Written | None]) -> None:
        files = [m.file for m in messages if m and m.books]
        _write(os.path.join(self.journal, COMMITTED), {"files": files, "books": sum(m.books for m in messages if m)})

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                apply._discard(os.path.join(self.journal, FILES, m.file))


def committed_results(spark, journal: str) -> DataFrame:
    """The results that the last commit names; none where nothing was committed."""
    found = _read(os.path.join(journal, COMMITTED)) or {"files": []}
    paths = [f"file://{os.path.abspath(os.path.join(journal, FILES, f))}" for f in found["files"]]
    return spark.read.schema(apply.RESULTS).json(paths) if paths else spark.createDataFrame([], apply.RESULTS)
