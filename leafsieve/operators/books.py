"""Whole books: copies of one another, statistics, sections, totals, and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsieve.functions.text import display_name, file_part

#: A page in so many books is filler and proves nothing about two of them; the share of the smaller that must be shared.
COMMON_BOOKS, MIN_OVERLAP = 6, 0.8


def duplicate_books(pages: DataFrame, archives: DataFrame, min_overlap: float = MIN_OVERLAP, common: int = COMMON_BOOKS) -> DataFrame:
    """(smaller, larger, shared, smaller_pages, overlap) of books whose distinct contents are mostly shared.

    Filler goes before books are paired, so a content is paired in at most common * (common - 1) / 2 ways.
    """
    good = F.coalesce("error", F.lit("")) == ""
    held = pages.where(good & (F.col("content_sha") != "")).join(archives.where(good).select("archive"), "archive", "left_semi")
    held = held.select("archive", "content_sha").distinct()
    # At most ``common`` books of a content come together: of a filler, counted, only the number does.
    rare = held.groupBy("content_sha").agg(F.count("*").alias("books")).where(F.col("books") < common)
    own = held.join(rare, "content_sha")
    sizes = own.groupBy("archive").agg(F.count("*").alias("n"))
    several = own.where("books > 1").select("archive", "content_sha")
    pairs = (
        several.withColumnRenamed("archive", "a").join(several.withColumnRenamed("archive", "b"), "content_sha").where("a < b")
        .groupBy("a", "b").agg(F.count("*").alias("shared"))
    )
    pairs = pairs.join(sizes.toDF("a", "size_a"), "a").join(sizes.toDF("b", "size_b"), "b")
    first = F.struct("size_a", "a") <= F.struct(F.col("size_b").alias("size_a"), F.col("b").alias("a"))
    out = pairs.select(
        F.when(first, F.col("a")).otherwise(F.col("b")).alias("smaller"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("larger"),
        "shared", F.least("size_a", "size_b").alias("smaller_pages"),
    )
    return out.withColumn("overlap", F.col("shared") / F.col("smaller_pages")).where(F.col("overlap") >= min_overlap)


def pair_order(pairs: DataFrame) -> DataFrame:
    """Pairs in the order of a report: the largest overlap first, then by the names of the books."""
    return pairs.orderBy(F.desc("overlap"), F.lower("smaller"), F.lower("larger"))


def in_order(archives: DataFrame) -> DataFrame:
    """Books in the order of a scan's result, by their path in lower case."""
    return archives.orderBy(F.lower("archive"), "archive")


def book_stats(members: DataFrame, to_remove: DataFrame) -> DataFrame:
    """(archive, grouped, marked): pages in any group, and pages that go."""
    keyed = to_remove.select("gid", "archive", "name", F.lit(1).alias("gone"))
    return members.join(keyed, ["gid", "archive", "name"], "left").groupBy("archive").agg(
        F.count("*").alias("grouped"), F.sum(F.coalesce("gone", F.lit(0))).alias("marked")
    )


def library_sections(archives: DataFrame) -> DataFrame:
    """(heading, books): by series, else the name of the folder."""
    folder = F.regexp_extract("archive", r"([^/\\]+)[/\\][^/\\]+$", 1)
    heading = F.coalesce(F.nullif("series", F.lit("")), F.nullif(folder, F.lit("")), F.lit("."))
    return archives.groupBy(heading.alias("heading")).agg(F.count("*").alias("books"))


def library_totals(archives: DataFrame) -> DataFrame:
    """One row: archives, pages, unreadable."""
    return archives.agg(
        F.count("*").alias("archives"), F.coalesce(F.sum("page_count"), F.lit(0)).cast("long").alias("pages"),
        F.count_if(F.coalesce("error", F.lit("")) != "").alias("unreadable"),
    )


def shown_name() -> Column:
    return display_name(F.col("series"), F.col("number"), F.col("archive"))


def library_search(archives: DataFrame, text: str) -> DataFrame:
    """Books whose shown name or file name holds the text, whatever its case."""
    wanted = text.strip().lower()
    return archives.where(F.contains(F.lower(shown_name()), F.lit(wanted)) | F.contains(F.lower(file_part(F.col("archive"))), F.lit(wanted)))
