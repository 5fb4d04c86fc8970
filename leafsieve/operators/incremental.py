"""Scanning again: what is known of a file already, what must be read, and where moved files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDENTITY = ["archive", "size", "mtime_ns"]


def cache_hits(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose size and time are as when they were scanned."""
    return files.join(cached.select(*IDENTITY), IDENTITY, "left_semi")


def cache_misses(files: DataFrame, cached: DataFrame) -> DataFrame:
    return files.join(cached.select(*IDENTITY), IDENTITY, "left_anti")


def invalidate(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of other archives than ``gone``."""
    return table.join(gone.select("archive"), "archive", "left_anti")


def put(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` with the rows of the archives in ``rows`` in place of its own."""
    return invalidate(table, rows.select("archive").distinct()).unionByName(rows)


def stale_errors(pages: DataFrame, codecs: str) -> DataFrame:
    """Pages that could not be decoded, by other decoders than the present ones."""
    return pages.where((F.coalesce("error", F.lit("")) != "") & (F.col("codecs").isNull() | (F.col("codecs") != codecs)))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("file", F.regexp_replace("archive", r"^.*/", ""))


def adopt_moved(misses: DataFrame, cached: DataFrame) -> DataFrame:
    """(archive, old): files that are, by name, size and time, exactly one cached book elsewhere."""
    old = _named(cached).select(F.col("archive").alias("old"), "file", "size", "mtime_ns")
    pairs = _named(misses).join(old, ["file", "size", "mtime_ns"]).where("archive <> old")
    return pairs.groupBy("archive").agg(F.count("*").alias("n"), F.min("old").alias("old")).where("n = 1").select("archive", "old")


def find_relocated(missing: DataFrame, listing: DataFrame) -> DataFrame:
    """(archive, status, found): each missing book (archive, size, mtime_ns) among the files of a folder."""
    files = _named(listing).select(F.col("archive").alias("path"), "file", "size", "mtime_ns")
    pairs = _named(missing).join(files, ["file", "size", "mtime_ns"], "left")
    one = pairs.groupBy("archive").agg(F.count("path").alias("n"), F.min("path").alias("path"))
    status = F.when(F.col("n") == 1, "found").when(F.col("n") > 1, "ambiguous").otherwise("not_found")
    return one.select("archive", status.alias("status"), F.when(F.col("n") == 1, F.col("path")).alias("found"))


def scan_eta(scans: DataFrame, total: int, total_bytes: int, elapsed: float, overdue: bool = False) -> DataFrame:
    """One row of counters of the books scanned (size, page_count, cached), and the seconds left.

    Only books that were read count towards the pace. It goes by bytes if the sizes are known, else by books;
    without a book that was read it is null, without a book left 0. With ``overdue`` a scan that has passed its totals has
    less than 0 seconds left, by as much as it went beyond them at its pace.
    """
    fresh = ~F.col("cached")
    sums = scans.agg(
        F.count("*").alias("done"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_done"), F.count_if(fresh).alias("books"),
        F.coalesce(F.sum(F.when(fresh, F.col("size"))), F.lit(0)).alias("bytes_read"),
        F.coalesce(F.sum(F.when(fresh, F.col("page_count"))), F.lit(0)).alias("pages_hashed"),
        F.coalesce(F.sum(F.when(~fresh, F.col("page_count"))), F.lit(0)).alias("pages_cached"),
    )
    left = F.lit(total_bytes) - F.col("bytes_done")
    left = left if overdue else F.greatest(left, F.lit(0))
    by_bytes = F.lit(elapsed) * left / F.greatest(F.col("bytes_done"), F.lit(1))
    by_books = F.lit(elapsed) * (F.lit(total) - F.col("done")) / F.col("done")
    eta = (
        F.when((F.col("done") >= total) & ~F.lit(overdue), 0.0).when(F.col("books") == 0, None)
        .when((F.lit(total_bytes) > 0) & (F.col("bytes_read") > 0), by_bytes).otherwise(by_books)
    )
    return sums.withColumn("eta", eta)


def carry_decisions(prior: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, decision, source) for new groups, of prior decisions (gid, decision, pages: array<struct<archive, name>>).

    A group with the same id takes its decision. Another decision follows its pages to the group that holds more than
    half of them, unless that group has one by its id or is claimed twice.
    """
    new = members.select("gid").distinct()
    same = prior.join(new, "gid", "left_semi").select("gid", "decision", F.col("gid").alias("source"))
    lost = prior.join(new, "gid", "left_anti")
    keys = lost.select(F.col("gid").alias("source"), "decision", F.size("pages").alias("n"), F.explode("pages").alias("p"))
    keys = keys.select("source", "decision", "n", "p.archive", "p.name")
    tally = keys.join(members.select("gid", "archive", "name"), ["archive", "name"]).groupBy("source", "decision", "n", "gid").agg(F.count("*").alias("shared"))
    claims = tally.where("shared * 2 > n").join(same.select("gid"), "gid", "left_anti")
    single = claims.withColumn("claimants", F.count("*").over(Window.partitionBy("gid"))).where("claimants = 1")
    return same.unionByName(single.select("gid", "decision", "source"))
