"""How far a run has come, told while it runs, and stopping it from another thread."""

from __future__ import annotations

import contextlib
import threading
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """A run that was stopped."""


@contextlib.contextmanager
def ticking(look: Callable[[], dict], tell: Callable[[dict], None], every: float = 1.0) -> Iterator[None]:
    """Tells what ``look`` finds every so often, when it has changed, and once more at the end."""
    ended, last = threading.Event(), [None]

    def once() -> None:
        seen = look()
        if seen != last[0]:
            last[0] = seen
            tell(seen)

    def run() -> None:
        while not ended.wait(every):
            once()

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        once()


class Watch:
    """A scan that is watched: books and bytes that were read, by accumulators, tasks by the status of its jobs, and the seconds left.

    The work is done in one thread, under a tag of its own; :meth:`cancel` may be called from any other and ends these jobs and no others.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None] = lambda seen: None, every: float = 1.0):
        self.context, self.tell, self.every, self.tag = spark.sparkContext, tell, every, f"leafsieve-{uuid.uuid4().hex}"
        self.books, self.bytes = self.context.accumulator(0), self.context.accumulator(0)
        self.total, self.total_bytes, self.began, self.cancelled = 0, 0, time.monotonic(), False

    def counter(self) -> Callable[[int], None]:
        """What a task calls with the size of each book that it has read."""
        read, size = self.books, self.bytes

        def count(bytes_: int) -> None:
            read.add(1)
            size.add(bytes_)

        return count

    def look(self) -> dict:
        tracker = self.context._jsc.sc().statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForTag(self.tag) if tracker.getJobInfo(j).isDefined() for s in tracker.getJobInfo(j).get().stageIds()]
        known = [s.get() for s in stages if s.isDefined()]
        done, size = self.books.value, self.bytes.value
        # By bytes, as the pace of a scan goes by them; none before a book was read.
        left = None if not size else round((time.monotonic() - self.began) * max(self.total_bytes - size, 0) / size, 1)
        return {
            "books": done, "of": self.total, "bytes": size, "of_bytes": self.total_bytes,
            "tasks": sum(s.numCompletedTasks() for s in known), "of_tasks": sum(s.numTasks() for s in known), "eta": 0.0 if done >= self.total else left,
        }

    @contextlib.contextmanager
    def reading(self, books: int, bytes_: int) -> Iterator[None]:
        """The part of a scan that reads so many books."""
        if self.cancelled:
            raise Cancelled("stopped before a book was read")
        self.total, self.total_bytes, self.began = books, bytes_, time.monotonic()
        self.context.addJobTag(self.tag)
        try:
            with ticking(self.look, self.tell, self.every):
                yield
        except Exception as ended:
            if self.cancelled:
                raise Cancelled(f"stopped after {self.books.value} of {books} books") from ended
            raise
        finally:
            self.context.removeJobTag(self.tag)

    def cancel(self) -> None:
        """End the scan: tasks stop with the book that they are at, and no further one begins."""
        self.cancelled = True
        self.context.cancelJobsWithTag(self.tag)
