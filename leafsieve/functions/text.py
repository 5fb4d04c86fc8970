"""Text, order and format functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def human_bytes(count: Column) -> Column:
    """1023 B, 1.5 KB, 5.0 MB: 1024-based, TB at most."""
    # A tie goes to the even digit.
    shown = lambda k: F.bround(count / float(1 << 10 * k), 1)
    out = F.format_string("%.1f TB", shown(4))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(count < 1 << 10 * (k + 1), F.format_string(f"%.1f {unit}", shown(k))).otherwise(out)
    return F.when(count < 1024, F.format_string("%d B", count.cast("long"))).otherwise(out)


def natural_key(name: Column) -> Column:
    """An array that orders names with numbers by value: text, number, text and so on, in lower case.

    A number is compared by its length without leading zeros, then by its digits, so it may be of
    any length. A name that starts with a digit begins with an empty text.
    """
    parts = F.regexp_extract_all(F.lower(name), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    # An own name, so that the two kinds of parts have one type.
    def key(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        number = part.rlike("^[0-9]")
        return F.struct(
            F.when(number, 1).otherwise(0).alias("kind"),
            F.when(number, F.length(digits)).otherwise(0).alias("length"),
            F.when(number, digits).otherwise(part).alias("text"),
        )

    lead = F.when(name.rlike("^[0-9]"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.concat(lead, parts), key)


def file_part(path: Column) -> Column:
    """What follows the last slash or backslash."""
    return F.regexp_replace(path, r"^.*[/\\]", "")


def safe_part(name: Column) -> Column:
    """A name that any file system takes."""
    clean = F.regexp_replace(file_part(name), r"[<>:\"/|?*\\\x00-\x1f]", "_")
    trimmed = F.regexp_replace(clean, r"^[ .]+|[ .]+$", "")
    return F.when(trimmed == "", "page").otherwise(trimmed)


def display_name(series: Column, number: Column, path: Column) -> Column:
    named = F.when(F.coalesce(number, F.lit("")) == "", series).otherwise(F.concat(series, F.lit(" #"), number))
    return F.when(F.coalesce(series, F.lit("")) == "", file_part(path)).otherwise(named)


def percent(share: Column) -> Column:
    """A share as whole percent, half to even: 12.5 % is 12%."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def near_edge(index: Column, page_count: Column, edge: int) -> Column:
    """Within ``edge`` pages of either end; a book of unknown length has no middle."""
    return (page_count <= 0) | (index < edge) | (index >= page_count - edge)


def renumber(image: Column, removed: Column) -> Column:
    """The number of a page after ``removed`` (an array of numbers) has gone; null if it goes itself."""
    return F.when(~F.array_contains(removed, image), image - F.size(F.filter(removed, lambda r: r < image)))


def version_key(version: Column) -> Column:
    """The numbers that a version begins with, without trailing zeros; a leading v and a suffix don't count."""
    start = F.regexp_extract(F.trim(version), r"^v?([0-9]+(?:\.[0-9]+)*)", 1)
    numbers = F.transform(F.regexp_extract_all(start, F.lit("([0-9]+)"), F.lit(1)), lambda p: p.cast("long"))
    last = F.array_max(F.transform(numbers, lambda n, i: F.when(n != 0, i + 1).otherwise(0)))
    return F.slice(numbers, F.lit(1), F.coalesce(last, F.lit(0)))


def is_newer(version: Column, than: Column) -> Column:
    """Whether a version comes after another; false if either has no number."""
    has = lambda v: F.trim(v).rlike("^v?[0-9]")
    return has(version) & has(than) & (version_key(version) > version_key(than))


def duration(seconds: Column) -> Column:
    """1 s to 59 s, minutes up to an hour, then hours."""
    return (
        F.when(seconds < 60, F.concat(F.greatest(F.lit(1), F.bround(seconds).cast("int")).cast("string"), F.lit(" s")))
        .when(seconds < 3600, F.concat(F.bround(seconds / 60).cast("int").cast("string"), F.lit(" min")))
        .otherwise(F.format_string("%.1f h", F.bround(seconds / 3600, 1)))
    )


def relative_path(path: Column, root: str) -> Column:
    """A path below ``root``, for showing; another stays as it is."""
    top = root.rstrip("/") + "/"
    return F.when(path.startswith(top), F.substr(path, F.lit(len(top) + 1))).otherwise(path)


def describe_group(pages: Column, books: Column) -> Column:
    return F.concat(pages.cast("string"), F.lit(" copies in "), books.cast("string"), F.lit(" book(s)"))


def describe_pair(smaller: Column, larger: Column, overlap: Column) -> Column:
    name = file_part(smaller)
    return F.concat(name, F.lit(" and "), file_part(larger), F.lit(" share "), percent(overlap), F.lit(" of "), name, F.lit("'s pages"))


def backup_name(name: Column) -> Column:
    """Whether a file may be a backup that a removal run has made."""
    return name.rlike(r"(?i)^.+\.(cbz|zip|cbr|rar|cb7|7z)\.bak(\.[0-9]+)?$")
