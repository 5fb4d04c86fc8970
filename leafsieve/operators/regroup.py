"""Clusters that go on from the last run: what is added and what is gone changes only the components that it touches.

Kept between runs are the fingerprints, the edges between those that are near, and the component of each node with an edge. A batch
compares its new fingerprints with all, not all with all. Components that lose a node are taken apart and put together again from the
edges that are left; the others are one node each, their least. What is joined then is a graph of new edges and of these.

Where fingerprints lie densely, edges grow with their square. Clusters can be kept without: then components that lose a node are found again from
their fingerprints, and new ones are linked to what is there, none of which is compared with one another again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.functions.hashing import ordered
from leafsieve.operators.components import connected_components
from leafsieve.operators.similarity import clusters, linked, near_pairs, similar_pairs
from leafsieve.runtime import materialize, measured


@dataclass(frozen=True)
class Clusters:
    """(dhash), (a, b) with a < b unsigned, and (node, component); nodes without edges are in no component. Without edges if these aren't kept."""

    hashes: DataFrame
    edges: DataFrame | None
    labels: DataFrame

    def roots(self) -> DataFrame:
        """(dhash, root) of all fingerprints, as :func:`leafsieve.operators.similarity.clusters` gives them."""
        found = self.labels.select(F.col("node").alias("dhash"), F.col("component").alias("found"))
        return self.hashes.join(found, "dhash", "left").select("dhash", F.coalesce("found", "dhash").alias("root"))


@dataclass(frozen=True)
class Change:
    """The clusters after a batch, its new fingerprints and edges, the rows of labels that are new or others, the nodes that are in no component any more, and their numbers."""

    clusters: Clusters
    new: DataFrame
    fresh: DataFrame | None
    changed: DataFrame
    left: DataFrame
    rows_changed: int
    rows_left: int


def _components(edges: DataFrame) -> DataFrame:
    """Components by the least node in unsigned order."""
    found = connected_components(edges.select(ordered(F.col("a")).alias("a"), ordered(F.col("b")).alias("b")))
    return found.select(ordered(F.col("node")).alias("node"), ordered(F.col("component")).alias("component"))


def _several(roots: DataFrame) -> DataFrame:
    """(node, component) of the clusters (dhash, root) of two or more."""
    roots = materialize(roots, "roots")
    led = roots.where("dhash <> root").select(F.col("dhash").alias("node"), F.col("root").alias("component"))
    return materialize(led.unionByName(led.select("component").distinct().select(F.col("component").alias("node"), "component")), "labels")


def start(hashes: DataFrame, threshold: int, edges: bool = True) -> Clusters:
    """Clusters of fingerprints (one column) from scratch; they go on with their edges kept or without."""
    hashes = materialize(hashes.toDF("dhash").where("dhash is not null").distinct(), "hashes")
    if not edges:
        return Clusters(hashes, None, _several(clusters(hashes, threshold)))
    edges = materialize(similar_pairs(hashes, threshold).select("a", "b"), "edges")
    return Clusters(hashes, edges, materialize(_components(edges), "labels"))


def advance(before: Clusters, added: DataFrame, gone: DataFrame, threshold: int) -> Change:
    """Clusters after some fingerprints (one column) have come and some are gone.

    Who is in both stays. Added ones that are there, and gone ones that are not, change nothing. Tables of ``before`` are read and not written over.
    """
    given = added.toDF("dhash").where("dhash is not null").distinct()
    lost = gone.toDF("dhash").join(given, "dhash", "left_anti").distinct()
    lost = materialize(lost.join(before.hashes, "dhash", "left_semi"), "lost")
    new = materialize(given.join(before.hashes, "dhash", "left_anti"), "new")
    stay = before.hashes.join(lost, "dhash", "left_anti")
    hashes, (rows,) = measured(stay.unionByName(new), "hashes", F.count("*"))
    if before.edges is None:
        return _advance_without_edges(before, hashes, rows, new, lost, threshold)
    fresh = near_pairs(new, hashes, threshold)
    # A pair of new ones is found from both.
    less, more = ordered(F.col("a")) < ordered(F.col("b")), F.struct("b", "a")
    fresh = fresh.where("a <> b").select(F.when(less, F.struct("a", "b")).otherwise(F.struct(more["b"].alias("a"), more["a"].alias("b"))).alias("e"))
    fresh = materialize(fresh.select("e.*").distinct(), "fresh")
    cut = lambda edges, end: edges.join(lost.withColumnRenamed("dhash", end), end, "left_anti")
    kept = cut(cut(before.edges, "a"), "b").select("a", "b")
    edges = materialize(kept.unionByName(fresh), "edges")
    # Components with a lost node, and all their nodes that are left.
    apart = before.labels.join(lost.withColumnRenamed("dhash", "node"), "node", "left_semi").select("component").distinct()
    apart = materialize(before.labels.join(apart, "component", "left_semi"), "apart")
    whole = before.labels.join(apart.select("component").distinct(), "component", "left_anti")
    inside = kept.join(apart.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b")

    def led(side: str) -> DataFrame:
        """(end, at): each end of a new edge, at its component if that is whole."""
        ends = fresh.select(F.col(side).alias(f"{side}_")).distinct()
        places = whole.select(F.col("node").alias(f"{side}_"), F.col("component").alias("at"))
        return ends.join(places, f"{side}_", "left").select(F.col(f"{side}_").alias(side), F.coalesce("at", f"{side}_").alias(f"{side}_at"))

    led_edges = fresh.join(led("a"), "a").join(led("b"), "b").select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    found = materialize(_components(materialize(led_edges.unionByName(inside), "joined")), "found")
    # Nodes of components that are led elsewhere, nodes that had none, and nodes of components that were taken apart.
    moved = whole.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component").where("`to` <> component").select("node", F.col("to").alias("component"))
    ends = fresh.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(whole.select("node"), "node", "left_anti")
    free = ends.unionByName(apart.join(lost.withColumnRenamed("dhash", "node"), "node", "left_anti").select("node")).distinct()
    old = apart.withColumnRenamed("component", "was")
    again = found.join(free, "node", "left_semi").join(old, "node", "left").where("was is null or was <> component").select("node", "component")
    changed, (rows_changed,) = measured(moved.unionByName(again), "changed", F.count("*"))
    left, (rows_left,) = measured(apart.select("node").join(found.select("node"), "node", "left_anti"), "left", F.count("*"))
    labels = before.labels.join(changed.select("node").unionByName(left), "node", "left_anti").select("node", "component").unionByName(changed)
    return Change(Clusters(hashes, edges, materialize(labels, "labels")), new, fresh, changed, left, rows_changed, rows_left)


def _advance_without_edges(before: Clusters, hashes: DataFrame, rows: int, new: DataFrame, lost: DataFrame, threshold: int) -> Change:
    """What :func:`advance` gives, of all fingerprints after the batch, so many as were counted, and of the new and lost ones."""
    apart = before.labels.join(lost.withColumnRenamed("dhash", "node"), "node", "left_semi").select("component").distinct()
    apart = materialize(before.labels.join(apart, "component", "left_semi"), "apart")
    left_over = apart.select(F.col("node").alias("dhash")).join(lost, "dhash", "left_anti")
    # What was apart from another component is so still, so each is found again by itself, all in one run.
    again = before.labels.where("false") if lost.isEmpty() else clusters(left_over, threshold).toDF("node", "component")
    whole = before.labels.join(apart.select("component").distinct(), "component", "left_anti").select("node", "component")
    roots = Clusters(hashes, None, whole.unionByName(again)).roots()
    if threshold > 0 and not new.isEmpty():
        fresh = new.select("dhash", F.lit(True).alias("fresh"))
        points = roots.join(fresh, "dhash", "left").select(F.col("dhash").alias("a"), ordered(F.col("root")).alias("label"), F.col("fresh").isNull().alias("old"))
        roots = linked(materialize(points, "points"), rows, threshold).select(F.col("a").alias("dhash"), ordered(F.col("label")).alias("root"))
    labels = _several(roots)
    changed, (rows_changed,) = measured(labels.join(before.labels, ["node", "component"], "left_anti"), "changed", F.count("*"))
    left, (rows_left,) = measured(before.labels.select("node").join(labels.select("node"), "node", "left_anti"), "left", F.count("*"))
    return Change(Clusters(hashes, None, labels), new, None, changed, left, rows_changed, rows_left)
