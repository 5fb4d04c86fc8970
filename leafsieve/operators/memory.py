"""What is remembered: pages known as junk and pages that are to be left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.functions.hashing import hex16, parse_hash
from leafsieve.operators.similarity import near_any


def known_by_source(known: DataFrame, hashes: DataFrame, source: str) -> DataFrame:
    return hashes.join(known.where(F.col("source") == source).select("sid"), "sid", "left_semi").select("dhash").distinct()


def imported_only(groups: DataFrame, members: DataFrame, removed: DataFrame, threshold: int) -> DataFrame:
    """Known groups that are marked, but near nothing that was removed here before. ``groups`` has decision."""
    near = near_any(members.select("dhash"), removed, threshold)
    mine = members.join(near, "dhash", "left_semi").select("gid")
    return groups.where("known and decision = 'delete'").join(mine, "gid", "left_anti")


def ignored_hash_map(ignored: DataFrame, hashes: DataFrame) -> DataFrame:
    """(gid, dhash): the stored ones; for an entry without any, the one that its id spells."""
    bare = ignored.join(hashes.select("gid"), "gid", "left_anti").select("gid", parse_hash(F.col("gid")).alias("dhash"))
    return hashes.select("gid", "dhash").unionByName(bare.where("dhash is not null")).distinct()


def merge_known(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (sid, note, source, tags, thumbnail) after remembering ``new``.

    The note and source of an entry stay; tags and thumbnail are filled in where there are none.
    ``new`` has a column ``at``; of entries with one id the earliest comes first.
    """
    rows = old.withColumn("at", F.lit(-1).cast("long")).unionByName(new)

    def first(column: str, when=None):
        return F.min_by(column, F.when(when, F.col("at")) if when is not None else F.col("at"))

    filled = F.coalesce("tags", F.lit("")) != ""
    return rows.groupBy("sid").agg(
        first("note").alias("note"), first("source").alias("source"),
        F.coalesce(first("tags", filled), F.lit("")).alias("tags"), first("thumbnail", F.col("thumbnail").isNotNull()).alias("thumbnail"),
    )


def merge_hashes(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of two child tables of fingerprints."""
    return old.unionByName(new).distinct()


def replace_ignored(old: DataFrame, new: DataFrame) -> DataFrame:
    """Fingerprints (gid, dhash) after ignoring ``new``: those of an entry that is ignored again are replaced."""
    return old.join(new.select("gid"), "gid", "left_anti").unionByName(new).distinct()


def widen_ignored(old: DataFrame, old_hashes: DataFrame, pack: DataFrame, pack_hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (gid, note) and fingerprints after importing a pack: fingerprints unite, and the notes of entries stay."""
    return old.unionByName(pack.join(old.select("gid"), "gid", "left_anti")), merge_hashes(ignored_hash_map(old, old_hashes), pack_hashes)


def learn_from_run(to_remove: DataFrame, members: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(sid, dhash): all fingerprints of groups of which a page went from one of the ``cleaned`` books."""
    gone = to_remove.join(cleaned.select("archive"), "archive", "left_semi").select("gid")
    return members.join(gone, "gid", "left_semi").select(F.col("gid").alias("sid"), "dhash").distinct()


def export_known(known: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entries as they are written to a list: fingerprints as sorted hex, the picture in base 64."""
    listed = hashes.groupBy("sid").agg(F.sort_array(F.collect_set(hex16(F.col("dhash")))).alias("hashes"))
    return known.join(listed, "sid", "left").select(
        F.col("sid").alias("id"), "note", "tags", F.coalesce("hashes", F.array().cast("array<string>")).alias("hashes"),
        F.when(F.length("thumbnail") > 0, F.base64("thumbnail")).alias("thumbnail"),
    )


def known_entries(known: DataFrame, hashes: DataFrame) -> DataFrame:
    """Entries with the number of their fingerprints, the newest first, then by id."""
    counts = hashes.groupBy("sid").agg(F.countDistinct("dhash").alias("hashes"))
    return known.join(counts, "sid", "left").withColumn("hashes", F.coalesce("hashes", F.lit(0))).orderBy(F.desc("created_at"), "sid")


def known_search(known: DataFrame, text: str) -> DataFrame:
    """Entries whose note, tags or id hold the text, whatever its case."""
    every = F.lower(F.concat_ws(" ", F.coalesce("note", F.lit("")), F.coalesce("tags", F.lit("")), "sid"))
    return known.where(F.contains(every, F.lit(text.strip().lower())))


def forget(table: DataFrame, ids: DataFrame, column: str = "sid") -> DataFrame:
    """Rows of other entries than ``ids``."""
    return table.join(ids.select(column), column, "left_anti")


def describe_known(known: DataFrame, changes: DataFrame) -> DataFrame:
    """``known`` with the notes and tags of ``changes`` (sid, note, tags) in place of its own."""
    new = changes.select("sid", F.col("note").alias("new_note"), F.col("tags").alias("new_tags"), F.lit(True).alias("hit"))
    out = known.join(new, "sid", "left")
    for c in ("note", "tags"):
        out = out.withColumn(c, F.when(F.col("hit"), F.col(f"new_{c}")).otherwise(F.col(c)))
    return out.select(*known.columns)
