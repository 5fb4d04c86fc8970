"""Decisions on rows, where ids may be null, repeat, or stand for several texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pyspark.sql.types import StructField

from leafsieve.runtime import materialize


def row_key(text_col: str) -> Column:
    """What tells the texts of an id apart: SHA-256 of the text as written; a null text has an empty one."""
    return F.coalesce(F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), F.lit(b""))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that are kept, each id and text once, with their columns.

    ``decided`` has a row for each of ``docs``: doc_id, row (of :func:`row_key`) and kept, which is the same for the same
    id and text.
    """
    here, at, place = (free_name(docs, name) for name in ("id", "row", "place"))
    keyed = docs.withColumns({here: F.col(id_col), at: row_key(text_col)})
    cases = decided.groupBy("doc_id", "row").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    cases = materialize(cases.select(F.col("doc_id").alias(f"{here}_"), F.col("row").alias(f"{at}_"), "kept"), "cases")
    same = F.col(here).eqNullSafe(F.col(f"{here}_")) & (F.col(at) == F.col(f"{at}_"))
    # Dealt out at any size: how many cases there are grows with the rows.
    plain = keyed.join(cases.drop("kept").hint("shuffle_hash"), same, "left_anti")
    # Repeated rows that stay, which are few: the one with the least hash of all its columns.
    some = keyed.join(cases.where("kept").drop("kept"), same, "left_semi")
    first = Window.partitionBy(here, at).orderBy(F.xxhash64(*map(_hashable, docs.schema.fields)))
    one = some.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return plain.unionByName(one).drop(here, at)


def _hashable(field: StructField) -> Column:
    """What can be hashed of a column; maps can't be, but as JSON."""
    column = F.col(f"`{field.name.replace('`', '``')}`")
    return F.to_json(F.struct(column.alias("c"))) if "map<" in field.dataType.simpleString() else column


def free_name(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower().rstrip("_") for c in docs.columns}
    while name in taken:
        name = f"own {name}"
    return name
