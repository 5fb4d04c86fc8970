"""Exact deduplication with a heavy-hitter split, in DataFrame operations only.

Digests are found once and written to the shared folder, so texts are read one time.
A Misra-Gries summary (Spark's frequent-items sketch) names the digests that may be
frequent; an exact count verifies them, and the at most ``HEAVY`` verified winners are
broadcast, so rows of hot groups never travel. A digest that the summary misses has at
most about rows/HEAVY rows, so the ordinary shuffle of the rest is even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.rows import keep_rows, row_key
from leafsieve.operators.heavy import heavy_hitters
from leafsieve.runtime import materialize

#: Most digests that the sketch may name; bounds the broadcast side (about 100 bytes each).
HEAVY = 256
#: Counters kept by the sketch.
COUNTERS = 4096
#: The characters that do not count in a comparison.
BLANKS = "[\\x20\\x09-\\x0D]+"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest, points): what tells a row's text apart, SHA-256 of the text without blanks, and the length as written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        row_key(text_col).alias("row"),
        F.sha2(F.regexp_replace(text, BLANKS, "").cast("binary"), 256).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``;
    a null text counts as empty. Of equal texts the one with the most code points stays,
    then the one with the smallest id (a null id comes last), then the one with the least SHA-256 as written. An
    empty table gives an empty result; further columns of ``docs`` are ignored, whatever their names. Rows that
    repeat an id and its text can't be told apart: each has the same answer; :func:`keep_distinct` keeps one of them.
    """
    return _decided(materialize(digests(docs, id_col, text_col), "digests")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _decided(table: DataFrame) -> DataFrame:
    """``table`` (of :func:`digests`) with keep_id, group_size and kept."""
    # Ids may be null, and a smaller one wins: order by (-points, no id, id, row).
    best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    summary = (best.alias("best"), F.count("*").alias("group_size"))
    heavy = F.broadcast(heavy_hitters(table, "digest", HEAVY, COUNTERS))
    winners = materialize(table.join(heavy, "digest", "left_semi").groupBy("digest").agg(*summary), "winners")
    hot = table.join(F.broadcast(winners), "digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    # Summaries are made before the shuffle; a join can be split where a digest still has many rows.
    rest = rest.join(rest.groupBy("digest").agg(*summary), "digest")
    same = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row") == F.col("best.row"))
    return hot.unionByName(rest).select("doc_id", "row", "digest", F.col("best.doc_id").alias("keep_id"), "group_size", same.alias("kept"))


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, the one that :func:`exact_dedup` keeps, with all columns.

    Rows are told apart by id and text, null ids too: a row never goes because another one of its id does. Of
    rows that repeat an id and its text one stays, the one with the least hash of all its columns.
    """
    return keep_rows(docs, _decided(materialize(digests(docs, id_col, text_col), "digests")), id_col, text_col)
