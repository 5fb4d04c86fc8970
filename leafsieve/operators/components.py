"""Connected components by alternating large and small stars, on DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.runtime import measured, release, ship

#: Edges that a task joins at once (16 bytes each).
AT_ONCE = 1 << 20


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the least of its neighbourhood to its larger neighbours."""
    near = _both(edges)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its least neighbour to itself and to its smaller neighbours. Edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    rest = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).unionByName(rest).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node that it is linked with) of edges, without the least ones."""
    nodes, index = np.unique(np.stack((a, b)), return_inverse=True)
    x, y = index.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root != root[root]).any():
            root = root[root]
    led = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[led], nodes[root[led]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a task, in batches of AT_ONCE, each node led straight to the least that the batch links it with."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        led = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in led], names=["a", "b"])

    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in range(2)])
        size += batch.num_rows
        if size >= AT_ONCE:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one, or none and only edges from larger ones: then all are at their component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("x"))
    nodes = ends.groupBy("x.node").agg(F.sum("x.down").alias("down"), F.min("x.down").alias("least"))
    return nodes.where("down > 1 or (down = 1 and least = 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``edges`` (two long columns); the component is its least node.

    Tasks first make forests of the edges that they hold. Rounds then grow with the square of the logarithm of the nodes
    at worst, and end as soon as only stars are left, be it after the tasks' own forests. After each, the edges
    are a table in the shared folder. Hubs are aggregated before they are shuffled, and the
    joins with them can be split by adaptive execution. Loops and null ends are ignored; an
    empty table gives no rows.
    """
    ship(edges.sparkSession)
    start = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b")
    table, (count,) = measured(start.mapInArrow(_forest, "a long, b long"), "edges", F.count("*"))
    while count and not _stars(table):
        old = table
        table, (count,) = measured(_small_star(_large_star(table)), "edges", F.count("*"))
        release(old)
    roots = table.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return table.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
