"""Places in an order of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafsieve.runtime import materialize

#: Bits of a row's number within its range.
_WITHIN = 33


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """A sorted frame with the place of each row, from 0 on: its number in its range, and the sizes of the ranges before.

    The sort is by ranges, as Spark's is; what is counted over is a row per range.
    """
    taken = {c.lower() for c in (*ordered.columns, name)}
    at, part, before = (f"{c}{'_' * max(map(len, taken))}" for c in ("at", "part", "before"))  # longer than any name there is
    table = materialize(ordered.withColumn(at, F.monotonically_increasing_id()), "ordered")
    number = F.shiftright(at, _WITHIN)
    sizes = table.groupBy(number.alias(part)).agg(F.count("*").alias("n"))
    sums = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select(part, F.coalesce(sums, F.lit(0)).alias(before)))  # as many rows as ranges
    placed = table.withColumn(part, number).join(starts, part)
    return placed.withColumn(name, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << _WITHIN) - 1))).drop(part, at, before)
