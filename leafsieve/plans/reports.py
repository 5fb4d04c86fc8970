"""What a run has found and done, as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsieve.operators.groups import member_order, review_warnings, sort_position


def _about() -> tuple[Column, ...]:
    """The fields of a group's document before its pages."""
    return (
        F.col("gid").alias("id"), F.when(F.col("kind") == "exact", "identical").otherwise("similar").alias("kind"), "known",
        F.bround("edge_share", 3).alias("edge_share"), review_warnings().alias("warnings"), F.col("page_count").alias("copies"),
        F.col("archive_count").alias("books"), F.col("recoverable_bytes").alias("bytes"),
    )


def group_rows(groups: DataFrame, members: DataFrame, key: str = "rank") -> DataFrame:
    """(position, rank, text): the documents of groups in an order, a row per copy, so that a group of any size is in no single row.

    The texts, read in the order of position and rank, are the documents one after the other: the first copy of a group opens its document,
    and the last one closes it.
    """
    head = F.to_json(F.struct(*_about()))
    opened = groups.select("gid", head.alias("head"), F.col("page_count").alias("last")).join(sort_position(groups, key), "gid")
    page = F.to_json(F.struct("archive", "name", (F.col("index") + 1).alias("page"), F.col("size").alias("bytes")))
    copies = member_order(members).select("gid", "rank", page.alias("page")).join(opened, "gid")
    begin = F.when(F.col("rank") == 0, F.concat(F.expr("left(head, char_length(head) - 1)"), F.lit(',"pages":['))).otherwise(",")
    end = F.when(F.col("rank") == F.col("last") - 1, "]}").otherwise("")
    return copies.select("position", "rank", F.concat(begin, "page", end).alias("text"))


def write_group_report(groups: DataFrame, members: DataFrame, path: str, key: str = "rank") -> None:
    """The documents of :func:`group_rows` as text files, which are the documents if read in the order of their names; tasks write ranges of rows."""
    group_rows(groups, members, key).orderBy("position", "rank").select("text").write.mode("overwrite").text(path)


def group_documents(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, document): each group with its copies in order, as JSON. All copies of a group are one row; :func:`group_rows` has none such."""
    copy = F.struct(F.lower("archive").alias("place"), "index", "archive", "name", "size")
    listed = members.groupBy("gid").agg(F.sort_array(F.collect_list(copy)).alias("copies"))
    pages = F.transform("copies", lambda c: F.struct(c["archive"].alias("archive"), c["name"].alias("name"), (c["index"] + 1).alias("page"), c["size"].alias("bytes")))
    document = F.struct(*_about(), pages.alias("pages"))
    return groups.join(listed, "gid").select("gid", F.to_json(document).alias("document"))


def pair_documents(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.to_json(F.struct("smaller", "larger", F.col("shared").alias("shared_pages"), "smaller_pages", F.bround("overlap", 3).alias("overlap"))).alias("document"))


def write_plan_csv(records: DataFrame, path: str) -> None:
    """Plan records as CSV files with a header; shares are rounded and flags are yes or no."""
    shown = records.withColumn("percent", F.bround("percent", 1)).withColumn("dry_run", F.when(F.col("dry_run"), "yes").otherwise("no"))
    shown.write.csv(path, header=True, mode="overwrite")


def write_plan_json(records: DataFrame, path: str) -> None:
    records.withColumn("percent", F.bround("percent", 1)).withColumn("removed_entries", F.split("removed_entries", "; ")).write.json(path, mode="overwrite")
