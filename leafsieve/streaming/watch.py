"""New pages against what is known, as they come in (an extension of the engine's own)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from leafsieve.operators.regroup import Clusters, advance
from leafsieve.operators.similarity import near_any
from leafsieve.runtime import scratch, shared_dir
from leafsieve.sources.bucketed import Table


def watch(pages: DataFrame, known: DataFrame, threshold: int, sink: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    """A query that hands the pages of each batch that are near a known fingerprint to ``sink`` (frame, batch).

    No state is kept: each batch is joined with the table ``known``, which is read anew. A batch
    that is tried again has the same number, so a sink can tell. Progress is kept under ``name`` in the shared folder.
    """

    def run(batch: DataFrame, number: int) -> None:
        hit = near_any(batch.select("dhash"), known, threshold)
        sink(batch.join(hit, "dhash", "left_semi").select(*batch.columns), number)

    place = f"{shared_dir(pages.sparkSession)}/leafsieve-watch-{name}"
    return pages.writeStream.foreachBatch(run).option("checkpointLocation", place).trigger(availableNow=True).start()


#: What is kept of watched clusters, and the keys: fingerprints, edges, components, what the last batch has changed, and which versions of these belong together.
_KEPT = {
    "hashes": ("dhash bigint", "dhash"), "edges": ("a bigint, b bigint", "a"), "labels": ("node bigint, component bigint", "node"),
    "changes": ("node bigint, component bigint", "node"), "state": ("name string, version bigint, batch bigint", "name"),
}


class KeptClusters:
    """Clusters that lie in kept tables below a folder and grow by batches with rising numbers.

    A batch compares its fingerprints with all earlier ones, and writes the buckets that it changes. Which versions of the tables belong together
    is one row each in a table of its own, which is put in place last; so a batch that failed on its way is begun again on what was before it, and one
    that is tried again after that changes nothing and gives the same rows.
    """

    def __init__(self, spark: SparkSession, path: str, threshold: int, buckets: int = 64):
        self.spark, self.threshold = spark, threshold
        self.tables = {n: Table(spark, f"{path.rstrip('/')}/{n}", ddl, key, 1 if n == "state" else buckets) for n, (ddl, key) in _KEPT.items()}

    def _state(self) -> tuple[int, dict[str, int]]:
        rows = self.tables["state"].read().collect()  # a row per table
        return max((r.batch for r in rows), default=-1), {r.name: r.version for r in rows}

    def _read(self, name: str, versions: dict[str, int]) -> DataFrame:
        table, version = self.tables[name], versions.get(name, 0)
        return table.read(version) if version else self.spark.createDataFrame([], table.schema)

    def clusters(self) -> Clusters:
        _, versions = self._state()
        return Clusters(*(self._read(n, versions) for n in ("hashes", "edges", "labels")))

    def add(self, hashes: DataFrame, number: int) -> DataFrame:
        """(node, component) of the fingerprints whose component is new or another one after batch ``number`` (one column)."""
        last, versions = self._state()
        if number <= last:
            return self._read("changes", versions)
        with scratch():
            change = advance(self.clusters(), hashes, hashes.limit(0), self.threshold)
            touched = change.clusters.edges.join(change.fresh.select("a").distinct(), "a", "left_semi")
            made = {
                "hashes": self.tables["hashes"].put(change.new), "edges": self.tables["edges"].put(touched), "labels": self.tables["labels"].put(change.changed),
                "changes": self.tables["changes"].overwrite(change.changed),
            }
            rows = [(name, manifest.number, number) for name, manifest in made.items()]
            self.tables["state"].overwrite(self.spark.createDataFrame(rows, _KEPT["state"][0]))
        for table in self.tables.values():
            table.vacuum(keep=2)
        return self._read("changes", self._state()[1])


def watch_clusters(pages: DataFrame, kept: KeptClusters, sink: Callable[[DataFrame, int], None], name: str) -> StreamingQuery:
    """A query that adds the fingerprints (dhash) of each batch to kept clusters and hands what has changed to ``sink`` (frame, batch).

    A page meets the pages of earlier batches. A batch that is tried again has the same number, changes nothing and hands on the same rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        sink(kept.add(batch.select(F.col("dhash")), number), number)

    place = f"{shared_dir(pages.sparkSession)}/leafsieve-watch-{name}"
    return pages.writeStream.foreachBatch(run).option("checkpointLocation", place).trigger(availableNow=True).start()
