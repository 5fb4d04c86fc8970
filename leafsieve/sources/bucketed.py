"""Tables that are kept between runs, in hash buckets, with a manifest for each version.

A table is a folder on any file system that Hadoop knows::

    data/kept_bucket=12/kept_version=3-5f0c…/part-*.parquet    rows of a bucket, as a version has written them
    manifest/000000003.json                          which version of each bucket is live

A change writes the buckets that it touches, and no others, and then a manifest with the next number. The manifest is put
in place by creating it, which fails where another writer was faster; that change is then made again on what the
other has left. So readers see a version or the next one, never a part, a run that dies leaves files that no manifest names,
and those who still read an older version find its files until :meth:`Table.vacuum`.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsieve.runtime import materialize, release

#: Buckets of a new table, attempts at a change while others write, and seconds after which a claim without a manifest is void.
BUCKETS, ATTEMPTS, CLAIM_SECONDS = 64, 5, 60


class Conflict(RuntimeError):
    """Others have changed the table at each attempt."""


@dataclass(frozen=True)
class Manifest:
    """The live version of each bucket that has rows."""

    number: int = 0
    buckets: int = BUCKETS
    live: dict[int, str] = field(default_factory=dict)


class Table:
    """A kept table of rows with a key column; all rows of a key lie in one bucket."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.new_buckets = spark, path.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], ddl).schema
        if clash := {"kept_bucket", "kept_version", "other key"} & {n.lower() for n in self.schema.names}:
            raise ValueError(f"a kept table has no columns called {', '.join(sorted(clash))}")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # --- manifests

    def _numbers(self) -> list[int]:
        where = self._path(f"{self.path}/manifest")
        if not self._fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, number: int | None = None) -> Manifest:
        """A version, the newest if none is named; one without buckets where there is no table."""
        numbers = self._numbers()
        if not numbers and number is None:
            return Manifest(buckets=self.new_buckets)
        number = numbers[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.path}/manifest/{number:09d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        found = json.loads(text)
        return Manifest(number, found["buckets"], {int(k): v for k, v in found["live"].items()})

    def _commit(self, manifest: Manifest) -> bool:
        """Put a manifest in place; False where there is one of its number."""
        target = self._path(f"{self.path}/manifest/{manifest.number:09d}.json")
        # It is written whole elsewhere; only its name is fought for.
        draft = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}.draft")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"buckets": manifest.buckets, "live": manifest.live}).encode()))
        finally:
            out.close()
        claim = self._path(f"{self.path}/manifest/{manifest.number:09d}.claim")
        try:
            self._fs.create(claim, False).close()
        except Py4JJavaError:
            self._fs.delete(draft, False)
            if not self._fs.exists(claim):
                raise
            # Between claiming and naming there is a moment only: one who has not come to that in CLAIM_SECONDS is dead.
            if not self._fs.exists(target) and time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
                self._fs.delete(claim, False)
            return False
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    # --- rows

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(buckets)).cast("int")

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of a version, the newest if none is named."""
        manifest = self.manifest(number)
        return self._rows(manifest, manifest.live)

    def _rows(self, manifest: Manifest, buckets) -> DataFrame:
        paths = [f"{self.path}/data/kept_bucket={b}/kept_version={manifest.live[b]}" for b in sorted(buckets) if b in manifest.live]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def put(self, rows: DataFrame, gone: DataFrame | None = None) -> Manifest:
        """Rows of the keys in ``rows`` take the place of those there are; keys in ``gone`` (the key column) leave.

        Only buckets with such keys are read and written. Repeated rows are kept; nothing is written where there is nothing to change.
        """
        rows = materialize(rows.select(*self.schema.names), "put")
        keys = rows.select(self.key)
        keys = materialize((keys.unionByName(gone.select(self.key)) if gone is not None else keys).distinct(), "keys")

        def change(manifest: Manifest) -> tuple[DataFrame, set[int]] | None:
            touched = {r.b for r in keys.select(self.bucket(manifest.buckets).alias("b")).distinct().collect()}  # at most all buckets
            if not touched:
                return None
            same = F.col(f"`{self.key}`").eqNullSafe(F.col("`other key`"))
            stay = self._rows(manifest, touched).join(keys.withColumnRenamed(self.key, "other key"), same, "left_anti")
            return stay.unionByName(rows), touched

        try:
            return self._changed(change)
        finally:
            release(rows)
            release(keys)

    def overwrite(self, rows: DataFrame) -> Manifest:
        """Rows in place of all that are there, which ``rows`` may read."""
        rows = materialize(rows.select(*self.schema.names), "overwrite")
        try:
            return self._changed(lambda m: (rows, set(range(m.buckets))))
        finally:
            release(rows)

    def rebucket(self, buckets: int) -> Manifest:
        """All rows dealt out to another number of buckets, for a table that has grown."""
        return self._changed(lambda m: (self._rows(m, m.live), set(range(buckets))), buckets)

    def _changed(self, change: Callable[[Manifest], tuple[DataFrame, set[int]] | None], buckets: int | None = None) -> Manifest:
        for _ in range(ATTEMPTS):
            manifest = self.manifest()
            wanted = change(manifest)
            if wanted is None:
                return manifest
            rows, touched = wanted
            count, version = buckets or manifest.buckets, f"{manifest.number + 1}-{uuid.uuid4().hex}"
            filled = self._write(rows, version, count)
            base = {} if buckets else manifest.live
            live = {b: v for b, v in base.items() if b not in touched} | dict.fromkeys(filled, version)
            made = Manifest(manifest.number + 1, count, live)
            if self._commit(made):
                return made
        raise Conflict(f"{self.path}: others have written {ATTEMPTS} times")

    def _write(self, rows: DataFrame, version: str, buckets: int) -> list[int]:
        """Write rows as a version of their buckets; the buckets that have any."""
        # Rebalancing splits a bucket that one task could not write, and joins small ones.
        dealt = rows.withColumns({"kept_bucket": self.bucket(buckets), "kept_version": F.lit(version)}).hint("rebalance", "kept_bucket")
        # Dynamic, so that a write that is begun again replaces its own folders and no others.
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kept_bucket", "kept_version").parquet(f"{self.path}/data")
        return [b for b in range(buckets) if self._fs.exists(self._path(f"{self.path}/data/kept_bucket={b}/kept_version={version}"))]

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` versions, and delete what none of them names; how many folders went.

        Not while others write: what they have not committed yet is named nowhere.
        """
        numbers = self._numbers()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        named, went = {(b, v) for m in kept for b, v in m.live.items()}, 0
        for n in numbers[:-keep]:
            for kind in ("json", "claim"):
                self._fs.delete(self._path(f"{self.path}/manifest/{n:09d}.{kind}"), False)
        top = self._path(f"{self.path}/data")
        for folder in self._fs.listStatus(top) if self._fs.exists(top) else ():
            name = folder.getPath().getName()
            if not name.startswith("kept_bucket="):
                continue
            for version in self._fs.listStatus(folder.getPath()):
                if (int(name.removeprefix("kept_bucket=")), version.getPath().getName().removeprefix("kept_version=")) not in named:
                    went += self._fs.delete(version.getPath(), True)
        return went
