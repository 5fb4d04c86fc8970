"""Frequent values by a Misra-Gries summary, merged in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks of the first level; each merges the summaries of its share of the partitions.
LEVEL = 256


def heavy_hitters(df: DataFrame, column: str, most: int, counters: int, least: int = 2) -> DataFrame:
    """At most ``most`` values of ``column``, estimated to come ``least`` times or more.

    Spark's frequent-items sketch keeps ``counters`` counters, so every value with more than about
    rows/counters rows is among its items, and the ``most`` largest are named. Estimates are upper bounds: verify
    them. The last task merges at most LEVEL summaries, whatever the number of partitions. No rows give no value.
    """
    sketches = df.groupBy((F.spark_partition_id() % LEVEL).alias("level")).agg(F.expr(f"approx_top_k_accumulate(`{column}`, {counters})").alias("sketch"))
    # Grouped by a constant, so that without rows there is no group.
    top = sketches.groupBy(F.lit("all")).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {counters}), {most})").alias("top"))
    return top.select(F.explode("top").alias("x")).where(F.col("x.count") >= least).select(F.col("x.item").alias(column))
