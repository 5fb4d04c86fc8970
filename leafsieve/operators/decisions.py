"""What a person has decided about groups: setting, marking what is safe, moving on, keeping a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsieve.operators.groups import is_safe, review_warnings
from leafsieve.runtime import materialize

DECISIONS = ("undecided", "keep", "delete", "ignore", "defer")
#: A saved session: decisions with the copies that were kept, and the pages that the group had.
SESSION = "gid string, decision string, kept array<struct<archive:string,name:string>>, pages array<struct<archive:string,name:string>>"


def set_decision(groups: DataFrame, chosen: DataFrame, decision: str) -> DataFrame:
    """``groups`` with the decision of the ``chosen`` ones (gid) set."""
    if decision not in DECISIONS:
        raise ValueError(f"no such decision: {decision}")
    hit = chosen.select("gid", F.lit(True).alias("hit")).distinct()
    out = groups.join(hit, "gid", "left")
    return out.withColumn("decision", F.when(F.col("hit"), decision).otherwise(F.col("decision"))).drop("hit")


def mark_safe(groups: DataFrame, min_books: int = 2) -> DataFrame:
    """``groups`` with undecided ones that need no second look marked for removal."""
    safe = (F.col("decision") == "undecided") & is_safe(min_books)
    return groups.withColumn("decision", F.when(safe, "delete").otherwise(F.col("decision")))


def mark_known(groups: DataFrame) -> DataFrame:
    """``groups`` with undecided known ones marked for removal."""
    return groups.withColumn("decision", F.when((F.col("decision") == "undecided") & F.col("known"), "delete").otherwise(F.col("decision")))


def _next(positions: DataFrame, wanted: Column, start: int) -> DataFrame:
    """The first wanted row at or after ``start``, going on from the top; an empty frame if there is none."""
    around = F.when(F.col("position") >= start, 0).otherwise(1)
    best = positions.where(wanted).agg(F.min(F.struct(around.alias("around"), "position", "gid")).alias("best"))
    return best.where("best is not null").select("best.gid", "best.position")


def next_undecided(positions: DataFrame, start: int) -> DataFrame:
    """``positions`` is (gid, position, decision) of the groups that are shown."""
    return _next(positions, F.col("decision") == "undecided", start)


def next_warning(positions: DataFrame, start: int) -> DataFrame:
    """``positions`` has the columns of groups, and position."""
    return _next(positions, F.size(review_warnings()) > 0, start)


def session(groups: DataFrame, members: DataFrame, kept: DataFrame) -> DataFrame:
    """What is saved of decided groups; ``kept`` is (gid, archive, name)."""
    listed = lambda df, name: df.groupBy("gid").agg(F.sort_array(F.collect_set(F.struct("archive", "name"))).alias(name))
    out = groups.select("gid", "decision").join(listed(kept, "kept"), "gid", "left").join(listed(members, "pages"), "gid")
    none = F.array().cast("array<struct<archive:string,name:string>>")
    out = out.withColumn("kept", F.coalesce("kept", none))
    return out.where((F.col("decision") != "undecided") | (F.size("kept") > 0)).select("gid", "decision", "kept", "pages")


def save_session(saved: DataFrame, path: str) -> None:
    """Write a session as JSON lines, in place of what is there."""
    # It may have been read from there.
    materialize(saved, "session").write.json(path, mode="overwrite")


def load_session(spark, path: str) -> DataFrame:
    return spark.read.schema(SESSION).json(path).where(F.col("decision").isin(*DECISIONS))
