"""Groups of repeated pages: building, judging, ranking and filtering them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafsieve.functions.hashing import hamming, hex16
from leafsieve.functions.text import near_edge
from leafsieve.operators.ranking import with_position
from leafsieve.operators.similarity import clusters, near_any
from leafsieve.options import GroupingOptions
from leafsieve.runtime import materialize, scratch

#: Reasons to look twice at a group, in the order in which they are given. Fixed values.
WARN_BLANK = "Contains blank or solid-colour pages."
WARN_ONE_BOOK = "All copies are in one book — this may be intentional."
WARN_COVER = "Includes a first page, which is usually the cover."
WARN_MID_BOOK = "Every copy sits mid-book; adverts and credits usually sit near the start or end."


#: Ids that are named where a prefix means several groups.
AMBIGUOUS = 5


@dataclass(frozen=True)
class Groups:
    """``groups`` has a row per gid, ``members`` a row per page and gid."""

    groups: DataFrame
    members: DataFrame


def collect_pages(pages: DataFrame, archives: DataFrame, options: GroupingOptions) -> DataFrame:
    """Pages that can be grouped, with ``page_count`` of their book: readable, and not left out by the options."""
    books = archives.where(F.coalesce("error", F.lit("")) == "").select("archive", "page_count")
    keep = F.coalesce(F.col("error"), F.lit("")) == ""
    if options.skip_first_page:
        keep &= F.col("index") != 0
    if options.skip_last_page:
        keep &= F.col("index") != F.col("page_count") - 1
    if not options.include_flat:
        keep &= ~F.col("flat")
    return pages.join(books, "archive").where(keep)


def distinct_hashes(pages: DataFrame) -> DataFrame:
    return pages.select("dhash").distinct()


def drop_ignored(pages: DataFrame, ignored: DataFrame, threshold: int) -> DataFrame:
    """Pages near no ignored fingerprint. This comes before clustering: a dropped page links nothing."""
    return pages.join(near_any(pages.select("dhash"), ignored, threshold), "dhash", "left_anti")


def build_groups(
    pages: DataFrame, archives: DataFrame, options: GroupingOptions | None = None,
    ignored: DataFrame | None = None, known: DataFrame | None = None,
) -> Groups:
    """Clusters of pages by fingerprint that meet the minimums, or hold a known fingerprint.

    ``ignored`` and ``known`` are frames of one column. Ignoring comes first, so it wins.
    """
    options = (options or GroupingOptions()).check()
    found = collect_pages(pages, archives, options)
    if ignored is not None:
        found = drop_ignored(found, ignored, options.threshold)
    if options.threshold > 0:
        # Costly to find, and read by each that needs pages or groups: so they are kept, and what they were made of goes.
        with scratch() as keep:
            found = keep(materialize(_with_hits(found.join(clusters(found.select("dhash"), options.threshold), "dhash"), known, options.threshold), "rooted"))
    else:
        found = _with_hits(found.withColumn("root", F.col("dhash")), known, options.threshold)
    members = found.withColumn("gid", hex16(F.col("root"))).withColumn("near_edge", near_edge(F.col("index"), F.col("page_count"), options.edge_pages))
    groups = _summary(members).where(
        F.col("known") | ((F.col("page_count") >= options.min_pages) & (F.col("archive_count") >= options.min_archives))
    )
    if options.threshold > 0:
        groups = materialize(groups, "groups")
    kept = members.join(groups.select("gid", "known"), "gid").drop("root", "hit", "page_count")
    return Groups(groups, kept)


def _with_hits(pages: DataFrame, known: DataFrame | None, threshold: int) -> DataFrame:
    """``pages`` with hit: whether the fingerprint is near one of ``known``."""
    if known is None:
        return pages.withColumn("hit", F.lit(False))
    near = near_any(pages.select("dhash"), known, threshold).withColumn("hit", F.lit(True))
    return pages.join(near, "dhash", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def _summary(members: DataFrame) -> DataFrame:
    """A row per gid. One distinct count only, so no row is multiplied; equal digests show in their least and greatest."""
    # The largest picture stands for a group; of equals the first in the order of members.
    first = F.min(F.struct(
        (-F.col("width") * F.col("height")).alias("area"), (-F.col("size")).alias("bytes"), F.lower("archive").alias("place"),
        "index", "archive", "name", "dhash",
    ))
    return members.groupBy("gid").agg(
        F.when(F.min("content_sha") == F.max("content_sha"), "exact").otherwise("similar").alias("kind"),
        F.bool_or("hit").alias("known"),
        F.avg(F.col("near_edge").cast("int")).alias("edge_share"),
        F.countDistinct("archive").alias("archive_count"),
        F.count("*").alias("page_count"),
        F.sum("size").alias("recoverable_bytes"),
        F.bool_or("flat").alias("any_flat"),
        (F.min("index") == 0).alias("any_cover"),
        first.alias("first"),
    ).select(
        "*",
        F.struct("first.archive", "first.name", "first.dhash", (-F.col("first.area")).alias("area")).alias("representative"),
    ).drop("first")


def with_kept(groups: DataFrame, members: DataFrame, kept: DataFrame) -> DataFrame:
    """``groups`` with the bytes of kept pages (gid, archive, name) taken off what can be recovered."""
    less = members.join(kept.select("gid", "archive", "name").distinct(), ["gid", "archive", "name"]).groupBy("gid").agg(F.sum("size").alias("less"))
    out = groups.join(less, "gid", "left")
    return out.withColumn("recoverable_bytes", F.col("recoverable_bytes") - F.coalesce("less", F.lit(0))).drop("less")


def member_order(members: DataFrame) -> DataFrame:
    """``members`` with their rank in the group: by book, then position. They are sorted by ranges, so no task gets a group."""
    order = members.withColumn("order of books", F.lower("archive")).orderBy("gid", "order of books", "index", "archive", "name").drop("order of books")
    placed = with_position(order, "place of all")
    firsts = placed.groupBy("gid").agg(F.min("place of all").alias("first of all"))
    return placed.join(firsts, "gid").withColumn("rank", F.col("place of all") - F.col("first of all")).select(*members.columns, "rank")


def review_warnings() -> Column:
    """array<string> of the reasons to look twice, for a row of groups."""
    flags = (
        (F.col("any_flat"), WARN_BLANK),
        ((F.col("archive_count") == 1) & ~F.col("known"), WARN_ONE_BOOK),
        (F.col("any_cover"), WARN_COVER),
        (F.col("edge_share") == 0, WARN_MID_BOOK),
    )
    return F.filter(F.array(*(F.when(c, F.lit(text)) for c, text in flags)), lambda w: w.isNotNull())


def is_safe(min_books: int = 2) -> Column:
    """Known, or identical over enough books and without a warning."""
    plain = (F.col("kind") == "exact") & (F.col("archive_count") >= max(2, min_books)) & (F.size(review_warnings()) == 0)
    return F.col("known") | plain


def spread(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(gid, spread): bits between the representative and the member farthest from it."""
    hashes = members.select("gid", "dhash").distinct()
    reps = groups.select("gid", F.col("representative.dhash").alias("of"))
    return hashes.join(reps, "gid").groupBy("gid").agg(F.max(hamming(F.col("dhash"), F.col("of"))).alias("spread"))


def copies_by_distance(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Members of similar groups with their distance to the representative."""
    reps = groups.where("kind = 'similar'").select("gid", F.col("representative.dhash").alias("of"))
    return members.join(reps, "gid").withColumn("distance", hamming(F.col("dhash"), F.col("of"))).drop("of")


def _sorts() -> dict[str, list]:
    """Sort keys, all descending; ties go by ascending gid. ``spread`` must be there for distance."""
    return {
        "rank": ["archive_count", "edge_share", "recoverable_bytes", "page_count"],
        "books": ["archive_count", "edge_share", "recoverable_bytes"],
        "space": ["recoverable_bytes", "archive_count"],
        "count": ["page_count", "recoverable_bytes"],
        "size": [F.col("representative.area")],
        "warning": [F.size(review_warnings()) > 0, "archive_count", "recoverable_bytes"],
        "edge": ["edge_share", "archive_count", "recoverable_bytes"],
        "distance": ["spread", "archive_count", "recoverable_bytes"],
    }


def sort_groups(groups: DataFrame, key: str = "rank") -> DataFrame:
    """Ordered by one of the named keys; an unknown one is books."""
    sorts = _sorts()
    return groups.orderBy(*(F.desc(c) if isinstance(c, str) else c.desc() for c in sorts.get(key, sorts["books"])), F.asc("gid"))


def sort_position(groups: DataFrame, key: str = "rank") -> DataFrame:
    """(gid, position) in the order of :func:`sort_groups`."""
    return with_position(sort_groups(groups, key).select("gid"))


FILTERS = ("all", "undecided", "marked", "deferred", "known", "identical", "similar", "warnings", "midbook")


def group_filter(groups: DataFrame, mode: str) -> DataFrame:
    """Groups of one of the ``FILTERS``; ``decision`` must be there for the ones that go by it."""
    tests = {
        "all": lambda: F.lit(True),
        "undecided": lambda: F.col("decision") == "undecided",
        "marked": lambda: F.col("decision") == "delete",
        "deferred": lambda: F.col("decision") == "defer",
        "known": lambda: F.col("known"),
        "identical": lambda: F.col("kind") == "exact",
        "similar": lambda: F.col("kind") == "similar",
        "warnings": lambda: F.size(review_warnings()) > 0,
        "midbook": lambda: F.col("edge_share") == 0,
    }
    return groups.where(tests[mode]())


def in_books(groups: DataFrame, members: DataFrame, books: DataFrame) -> DataFrame:
    """Groups with a copy in one of ``books`` (a frame of archive)."""
    held = members.join(books.select("archive"), "archive", "left_semi").select("gid")
    return groups.join(held, "gid", "left_semi")


def select_groups(groups: DataFrame, prefixes: list[str]) -> DataFrame:
    """The groups that id prefixes name; a prefix that names none or several, or is empty, raises ValueError."""
    wanted = [p.strip().lower() for p in prefixes]
    if not wanted or not all(wanted):
        raise ValueError("an empty group id")
    spark = groups.sparkSession
    table = spark.createDataFrame([(p,) for p in wanted], "prefix string")
    # As many rows as prefixes come back, each with at most two ids.
    hits = F.broadcast(table).join(groups.select("gid"), F.col("gid").startswith(F.col("prefix")), "left").groupBy("prefix").agg(F.count("gid").alias("n"))
    bad = hits.where("n <> 1").orderBy("prefix").first()
    if bad and not bad.n:
        raise ValueError(f"{bad.prefix}: no such group")
    if bad:
        some = [r.gid for r in groups.where(F.col("gid").startswith(bad.prefix)).select("gid").orderBy("gid").limit(AMBIGUOUS).collect()]
        raise ValueError(f"{bad.prefix}: {bad.n} groups start so: {', '.join(some)}" + (" and others" if bad.n > AMBIGUOUS else ""))
    return groups.join(F.broadcast(table), F.col("gid").startswith(F.col("prefix")), "left_semi")


def summarise(groups: DataFrame, to_remove: DataFrame) -> DataFrame:
    """One row of headline numbers. ``groups`` has decision, ``to_remove`` a row per page that goes."""
    marked = F.col("decision") == "delete"
    pages = to_remove.agg(F.count("*").alias("marked_pages"))
    heads = groups.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.count_if(marked).alias("marked_groups"),
        F.coalesce(F.sum(F.when(marked, F.col("recoverable_bytes"))), F.lit(0)).alias("recoverable"),
    )
    # Two rows of one each.
    return heads.withColumn("one", F.lit(1)).join(pages.withColumn("one", F.lit(1)), "one").drop("one")
