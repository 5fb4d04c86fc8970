"""From decisions to a plan for each book, and the limits that keep a plan from being carried out."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsieve.functions.text import file_part, natural_key, near_edge, percent

MAX_FRACTION = 0.25
#: Why a book is in a plan file but is not touched, and the columns of that file. Fixed values.
OVER_LIMIT = "would lose too large a share of its pages"
PROTECTED = "in a protected folder"
LEFT = "a .cbr or .cb7, left unchanged"
CSV_COLUMNS = ("archive", "status", "reason", "pages_removed", "original_pages", "percent", "dry_run", "removed_entries")


def pages_to_remove(members: DataFrame, decisions: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Members of groups whose decision is delete, without the kept (gid, archive, name)."""
    marked = decisions.where("decision = 'delete'").select("gid")
    out = members.join(marked, "gid", "left_semi")
    return out if kept is None else out.join(kept, ["gid", "archive", "name"], "left_anti")


def off_edge(members: DataFrame, archives: DataFrame, edge: int) -> DataFrame:
    """(gid, archive, name) of copies near no edge, which are then spared. The window is apart from that of grouping."""
    counts = archives.select("archive", "page_count")
    found = members.join(counts, "archive", "left")
    return found.where(~near_edge(F.col("index"), F.coalesce("page_count", F.lit(0)), edge)).select("gid", "archive", "name")


def build_plans(to_remove: DataFrame, archives: DataFrame) -> DataFrame:
    """(archive, original_pages, removed): the pages that go, each once, in the order of reading; a missing length is 0."""
    one = to_remove.groupBy("archive", "name").agg(F.max_by("index", "gid").alias("index"), F.max_by("content_sha", "gid").alias("content_sha"))
    item = F.struct("index", natural_key(F.col("name")).alias("key"), "name", "content_sha")
    plans = one.groupBy("archive").agg(F.sort_array(F.collect_list(item)).alias("items"))
    plans = plans.select("archive", F.transform("items", lambda x: F.struct(x["name"].alias("name"), x["index"].alias("index"), x["content_sha"].alias("content_sha"))).alias("removed"))
    counts = archives.select("archive", F.col("page_count").alias("original_pages"))
    return plans.join(counts, "archive", "left").select("archive", F.coalesce("original_pages", F.lit(0)).alias("original_pages"), "removed")


def n_removed() -> Column:
    return F.size("removed")


def fraction() -> Column:
    """The share of the book that goes; all of it if its length is unknown."""
    return F.when(F.col("original_pages") <= 0, 1.0).otherwise(n_removed() / F.col("original_pages"))


def takes_cover() -> Column:
    return F.exists("removed", lambda x: x["index"] == 0)


def takes_last_page() -> Column:
    return (F.col("original_pages") > 0) & F.exists("removed", lambda x: x["index"] == F.col("original_pages") - 1)


def converts(kind: Column | None = None) -> Column:
    """Whether a book is written anew as a zip: a rar or 7z archive, by what was found in it (``kind``), else by its name."""
    named = F.lower(F.col("archive")).rlike(r"\.(cbr|cb7|rar|7z)$")
    return named if kind is None else F.coalesce(F.when(kind.isin("rar", "7z", "zip"), kind != "zip"), named)


def plan_flags(plans: DataFrame, kind: Column | None = None) -> DataFrame:
    return plans.withColumns({
        "remaining": F.col("original_pages") - n_removed(), "fraction": fraction(), "takes_cover": takes_cover(), "takes_last_page": takes_last_page(),
        "converts": converts(kind),
    })


def split_by_fraction(plans: DataFrame, most: float = MAX_FRACTION) -> DataFrame:
    """``plans`` with ``over``: true if more than ``most`` of the book would go."""
    return plans.withColumn("over", fraction() > most)


def split_cbr(plans: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """``plans`` with ``leave``: true for a book that is no zip by name, or by what ``kinds`` (archive, kind) found in it."""
    named = F.lower(F.col("archive")).rlike(r"\.(cbr|cb7|rar|7z)$")
    if kinds is None:
        return plans.withColumn("leave", named)
    out = plans.join(kinds.select("archive", "kind"), "archive", "left")
    return out.withColumn("leave", named | F.coalesce(F.col("kind").isin("rar", "7z"), F.lit(False))).drop("kind")


def split_protected(plans: DataFrame, folders: list[str]) -> DataFrame:
    """``plans`` with ``protected``: true for a book that is one of the folders or lies under one. Blank folders don't count."""
    roots = [os.path.abspath(f.strip()).rstrip("/") for f in folders if f.strip()]
    inside = F.lit(False)
    for root in roots:
        inside = inside | (F.col("archive") == root) | F.col("archive").startswith(f"{root}/")
    return plans.withColumn("protected", inside)


def describe_plan(names: int = 3) -> Column:
    """removing 5 of 20 (25%), 15 left: p2.jpg, p9.jpg, p10.jpg and 2 more"""
    listed = F.transform(F.slice("removed", 1, names), lambda x: file_part(x["name"]))
    more = F.when(n_removed() > names, F.concat(F.lit(" and "), n_removed() - names, F.lit(" more"))).otherwise("")
    total = F.when(F.col("original_pages") != 0, F.concat(F.lit(" of "), "original_pages")).otherwise("")
    left = F.greatest(F.col("original_pages") - n_removed(), F.lit(0))
    return F.concat(F.lit("removing "), n_removed(), total, F.lit(" ("), percent(fraction()), F.lit("), "), left, F.lit(" left: "), F.array_join(listed, ", "), more)


def plan_records(plans: DataFrame, skipped: DataFrame, dry_run: bool) -> DataFrame:
    """A row per book of a plan file: those that are planned, and the skipped ones with their ``reason``."""
    every = plans.withColumn("status", F.lit("planned")).withColumn("reason", F.lit("")).unionByName(skipped.withColumn("status", F.lit("skipped")), allowMissingColumns=True)
    return every.select(
        "archive", "status", "reason", n_removed().cast("long").alias("pages_removed"), F.col("original_pages").cast("long").alias("original_pages"),
        (fraction() * 100).alias("percent"), F.lit(dry_run).alias("dry_run"), F.array_join(F.transform("removed", lambda x: x["name"]), "; ").alias("removed_entries"),
    )


def space_needed(plans: DataFrame, files: DataFrame, free: DataFrame, backup_volume: str | None, output_volume: str | None, backups: bool = True) -> DataFrame:
    """(volume, needed, free) of volumes that can't hold what a run writes.

    ``files`` is (archive, size, volume), ``free`` (volume, free). What stays adds up; a temporary file replaces its
    book, so of those only the largest counts.
    """
    books = plans.select("archive").join(files, "archive")
    if output_volume is not None:
        kept, passing = books.select(F.lit(output_volume).alias("volume"), "size"), None
    elif backups:
        target = F.col("volume") if backup_volume is None else F.lit(backup_volume)
        kept, passing = books.select(target.alias("volume"), "size"), books.where(target != F.col("volume"))
    else:
        kept, passing = None, books
    parts = []
    if kept is not None:
        parts.append(kept.groupBy("volume").agg(F.sum("size").alias("part")))
    if passing is not None:
        parts.append(passing.groupBy("volume").agg(F.max("size").alias("part")))
    need = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    need = need.groupBy("volume").agg(F.sum("part").alias("needed"))
    return need.join(free, "volume").where("free < needed").select("volume", "needed", "free")


def clean_report(results: DataFrame) -> DataFrame:
    """One row: removed and bytes_freed of the results without error or skip, and how many failed."""
    good = F.col("error").isNull() & ~F.col("skipped")
    return results.agg(
        F.coalesce(F.sum(F.when(good, F.col("removed"))), F.lit(0)).alias("removed"),
        F.coalesce(F.sum(F.when(good, F.col("bytes_freed"))), F.lit(0)).alias("bytes_freed"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("failed"),
    )
