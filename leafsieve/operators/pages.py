"""Names, kinds, order and metadata of archives and their entries, as column expressions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafsieve.functions.text import natural_key

#: Kinds of pictures that are pages, names that never are, and suffixes of archives.
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "gif", "bmp", "avif", "jxl", "tif", "tiff")
NO_PAGES = ("comicinfo.xml", "thumbs.db", ".ds_store")
ARCHIVE_SUFFIXES = ("cbz", "zip", "cbr", "rar", "cb7", "7z")
WALKED_SUFFIXES = ("cbz", "zip", "cbr", "cb7")
#: Prefix of the temporary file that a rewrite makes.
TEMP_PREFIX = ".leafsieve-"


def is_page_name(name: Column) -> Column:
    """Whether an entry is a page: a picture by its suffix, not hidden, no folder and no leftover of an operating system."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return (
        ~name.rlike(r"[/\\]$") & ~base.startswith(".") & ~F.lower(base).isin(*NO_PAGES) & ~F.contains(name, F.lit("__MACOSX"))
        & F.lower(base).rlike(rf"[^.]\.({'|'.join(IMAGE_SUFFIXES)})$")
    )


def is_archive_name(path: Column, walked: bool = True) -> Column:
    """Whether a file may be a book; one that is named, not walked to, may also be a plain rar or 7z file."""
    base = F.regexp_replace(path, r"^.*/", "")
    suffixes = WALKED_SUFFIXES if walked else ARCHIVE_SUFFIXES
    return F.lower(base).rlike(rf"[^.]\.({'|'.join(suffixes)})$") & ~base.startswith("._") & ~base.startswith(TEMP_PREFIX)


def matches_globs(path: Column, globs: list[str]) -> Column:
    """Whether the last part of a path, or all of it, matches a glob. A star crosses slashes; blank globs don't count."""
    out = F.lit(False)
    base = F.regexp_replace(path, r"^.*/", "")
    for glob in (g.strip() for g in globs):
        if glob:
            # Python's anchors, for a pattern that is searched for.
            pattern = "^" + fnmatch.translate(glob).replace(r"\z", "").replace(r"\Z", "") + "$"
            out = out | base.rlike(pattern) | path.rlike(pattern)
    return out


def disposition(path: Column, excluded: Column) -> Column:
    """What a survey does with a file that it walks to."""
    return (
        F.when(excluded, "excluded").when(is_archive_name(path), "found").when(F.lower(path).rlike(r"[^./]\.pdf$"), "pdf")
        .when(is_archive_name(path, walked=False), "not_walked").otherwise("other")
    )


def detect_kind(head: Column, path: Column) -> Column:
    """zip, rar, 7z or unknown: by the first bytes, else by the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return (
        F.when(F.hex(head).startswith("504B"), "zip").when(F.hex(head).startswith("52617221"), "rar").when(F.hex(head).startswith("377ABCAF271C"), "7z")
        .when(suffix.isin("cbz", "zip"), "zip").when(suffix.isin("cbr", "rar"), "rar").when(suffix.isin("cb7", "7z"), "7z").otherwise("unknown")
    )


def reading_order(entries: DataFrame) -> DataFrame:
    """``entries`` (archive, name) with ``index``, the place in natural order among the pages of the archive."""
    place = F.row_number().over(Window.partitionBy("archive").orderBy(natural_key(F.col("name")), "name")) - 1
    return entries.withColumn("index", place)


#: A document with more bytes than this is not read.
MOST_METADATA = 4 << 20


def read_metadata(df: DataFrame, xml_col: str) -> DataFrame:
    """``df`` with series, number and title from the children of the root, by local name; null where there is none.

    A broken or oversized document gives nulls. Of elements of one name the first counts.
    """
    text = F.regexp_replace(F.col(xml_col).cast("string"), "^﻿", "")
    fields = "Series array<string>, Number array<string>, Title array<string>"
    parsed = F.from_xml(F.when(F.octet_length(text) <= MOST_METADATA, text), fields, {"ignoreNamespace": "true"})
    out = df.withColumn("__xml", parsed)
    for name in ("Series", "Number", "Title"):
        value = F.substring(F.trim(F.regexp_replace(F.get(F.col(f"__xml.{name}"), F.lit(0)), r"\s+", " ")), 1, 200)
        out = out.withColumn(name.lower(), F.nullif(value, F.lit("")))
    return out.drop("__xml")
