"""What removal runs have done, and what can be taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CSV_COLUMNS = ("run", "when", "source", "book", "cleaned_file", "backup", "pages_removed", "removed_entries", "bytes_freed", "converted", "status")


def load_history(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with their items, the newest first. A run without items stays, an item without a run goes."""
    own = items.withColumnRenamed("id", "item_id")
    return runs.withColumnRenamed("id", "run_id").join(own, "run_id", "left").orderBy(F.desc("started_at"), F.desc("run_id"), "item_id")


def run_status(exists: dict[str, Column] | None = None) -> Column:
    """Why a book can or can't be put back. The conditions are tried in order.

    ``exists`` has boolean columns for archive, backup, output and unchanged (the output is as the run left
    it); by default those are archive_exists and so on.
    """
    on = exists or {k: F.col(f"{k}_exists") for k in ("archive", "backup", "output")} | {"unchanged": F.col("unchanged")}
    name = F.regexp_replace("archive", r"^.*/", "")
    return (
        F.when(F.coalesce("restored_at", F.lit(0.0)) != 0, F.concat(F.lit("restored "), F.date_format(F.timestamp_seconds("restored_at"), "yyyy-MM-dd HH:mm")))
        .when(F.col("backup").isNull() & (F.col("output") != F.col("archive")) & on["archive"], "the original was never changed")
        .when(F.col("backup").isNull(), "no backup was kept")
        .when(~on["backup"], "the backup has since been deleted")
        .when(on["output"] & ~on["unchanged"], "changed since the run")
        .when(F.col("converted") & on["archive"], F.concat(name, F.lit(" already exists")))
        .otherwise("can be restored")
    )


def output_unchanged(size: Column, mtime_ns: Column) -> Column:
    """Whether a file is as recorded; without a record it counts as unchanged, without a file as changed."""
    recorded = F.col("output_size").isNotNull() & F.col("output_mtime_ns").isNotNull()
    return F.when(~recorded, True).otherwise(F.coalesce((size == F.col("output_size")) & (mtime_ns == F.col("output_mtime_ns")), F.lit(False)))


def run_totals(runs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, removed, bytes_freed, restorable) of each run; ``items`` has status."""
    sums = items.groupBy("run_id").agg(
        F.sum("removed").alias("removed"), F.sum("bytes_freed").alias("bytes_freed"), F.count_if(F.col("status") == "can be restored").alias("restorable")
    )
    out = runs.select("id").join(sums.withColumnRenamed("run_id", "id"), "id", "left")
    return out.select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("removed", "bytes_freed", "restorable")))


def record_run(results: DataFrame, plans: DataFrame) -> DataFrame:
    """Items of a run: results that succeeded, took a page and left a file, with the names of the plan; none means that there is no run."""
    done = results.where(F.col("error").isNull() & ~F.col("skipped") & (F.col("removed") > 0) & F.col("output").isNotNull())
    names = plans.select("archive", F.sort_array(F.transform("removed", lambda x: x["name"])).alias("pages"))
    return done.join(names, "archive", "left").select(
        "archive", "output", "backup", "removed", F.coalesce("pages", F.array().cast("array<string>")).alias("pages"), "bytes_freed", "converted"
    )


def history_csv(runs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per book and run; ``items`` has status."""
    return items.join(runs.select(F.col("id").alias("run_id"), "started_at", "source"), "run_id").select(
        F.col("run_id").alias("run"), F.date_format(F.timestamp_seconds("started_at"), "yyyy-MM-dd HH:mm").alias("when"), "source",
        F.col("archive").alias("book"), F.col("output").alias("cleaned_file"), F.coalesce("backup", F.lit("")).alias("backup"),
        F.col("removed").alias("pages_removed"), F.array_join("pages", "; ").alias("removed_entries"), "bytes_freed",
        F.when(F.col("converted"), "yes").otherwise("no").alias("converted"), "status",
    )


def backups_to_clean(found: DataFrame, items: DataFrame, runs: DataFrame) -> DataFrame:
    """Of the backups ``found`` (path) those that no pinned run needs."""
    pinned = items.join(runs.where("pinned").select(F.col("id").alias("run_id")), "run_id", "left_semi").select(F.col("backup").alias("path"))
    return found.join(pinned.where("path is not null"), "path", "left_anti")


def pin(runs: DataFrame, run_id: int, pinned: bool = True) -> DataFrame:
    return runs.withColumn("pinned", F.when(F.col("id") == run_id, pinned).otherwise(F.col("pinned")))


def mark_restored(items: DataFrame, item_id: int, at: float) -> DataFrame:
    return items.withColumn("restored_at", F.when(F.col("id") == item_id, at).otherwise(F.col("restored_at")))
