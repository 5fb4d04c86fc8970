"""How far the words of the sources of each language diverge, by tiles of source blocks.

Terms are counted where the texts are. The count vectors of the sources of a language, over the language's kept terms, are packed into rows
of CHUNK terms, and the sources are numbered and cut into blocks of BLOCK. Every pair of blocks is a tile, and a tile gets
a task for each strip of STRIP chunks: the rows of its two blocks are replicated to it, it lays chunk after chunk out as a
small matrix of shares, and adds up the divergence of each of its pairs of sources. So a task holds at most 2 * BLOCK sources by
STRIP * CHUNK terms, however many sources, terms and documents there are, and no pair of rows is joined.

All arithmetic is on whole numbers. With c occurrences of a term in a group, N of all its kept terms, and V kept terms, the term's
share is p = 1 + floor(ONE * (c + 2) / (N + 2 * V)), and two shares diverge by floor((p - q)^2 / (p + q)).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafsieve.llm.textwork import slices, tidy
from leafsieve.operators.ranking import with_position
from leafsieve.runtime import materialize, release, ship

#: Documents of a language in which a kept term is, ranks of terms that are told, and what shares are out of.
LEAST_DOCS, MOST_RANKS, ONE = 10, 10, 1_000_000_000
#: Sources in a block, terms in a chunk, and chunks in a strip.
BLOCK, CHUNK, STRIP = 16, 8192, 8
#: Terms of all groups together that a task counts before it hands them on, and bytes of one text that are split at once.
AT_ONCE, STRETCH = 400_000, 1 << 22

#: [^\x00-\x40\x5B-\x60\x7B-\x7F] over UTF-8: ASCII letters and all bytes of other code points; the rest parts terms. Only A-Z are lower-cased.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_COUNTS_DDL = "lang string, source string, term string, n long, docs long"
_PAIRS_DDL = "lang string, source string, item string, value long"


def _split(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists; terms may come twice."""
    text, at = text.translate(_LETTERS), 0
    while len(text) - at > STRETCH:
        cut = text.find(b" ", at + STRETCH)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def _count(at_once: int):
    """Counts the terms of a task's texts, and hands them on when it holds more than ``at_once`` terms of groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, source, term, occurrences, documents), and a row without a term for each group that the task has seen."""
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = pa.array([*n, None], type=pa.binary()).cast(pa.string())
                same = [pa.array([x]).take(pa.array(np.zeros(len(terms), dtype=np.int32))) for x in (lang, source)]
                counts = [pa.array([*values, 0], type=pa.int64()) for values in (n.values(), map(docs.__getitem__, n))]
                yield pa.RecordBatch.from_arrays([*same, terms, *counts], schema=_COUNTS)
            held.clear()

        for batch in batches:
            langs, sources = (batch.column(k).to_pylist() for k in (1, 2))
            for first, texts in slices(batch.column(0).cast(pa.binary()).to_pylist()):
                for k, text in enumerate(texts, first):
                    n, docs = held.setdefault((langs[k], sources[k]), (Counter(), Counter()))
                    distinct: set[bytes] = set()
                    for terms in _split(text):
                        n.update(terms)
                        distinct.update(terms)
                    docs.update(distinct)
                if sum(len(n) for n, _ in held.values()) > at_once:
                    yield from rows()
                    tidy()
        yield from rows()

    return run


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", at_once: int = AT_ONCE) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term, and documents that have it; a row with a null term for each group.

    Terms are runs of ASCII letters and of code points from U+0080 on; nulls are ''.
    """
    ship(docs.sparkSession)
    given = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    return given.mapInArrow(_count(at_once), _COUNTS_DDL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(ONE * (c + 2) / total) of counts from 0 on, as unsigned integers, by long division to the base of 1000."""
    whole, rest = np.divmod(counts.astype(np.uint64) + np.uint64(2), np.uint64(total))
    for _ in range(3):  # ONE is 1000 ** 3
        more, rest = np.divmod(rest * np.uint64(1000), np.uint64(total))
        whole = whole * np.uint64(1000) + more
    return whole + np.uint64(1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of unsigned shares."""
    apart = np.maximum(p, q) - np.minimum(p, q)
    return apart * apart // (p + q)


def _tile(block_size: int, strip_terms: int):
    """Compares the sources of two blocks over the terms of a strip."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The divergence of each pair of sources of a tile, over the terms of a strip."""
        lang, strip, low, high = (k.as_py() for k in key)
        table = table.sort_by("chunk")
        rows = table.select(["chunk", "g", "source", "total", "kept", "lo"]).to_pylist()
        lists = [table.column(c).combine_chunks() for c in ("places", "counts")]
        flat, cuts = [x.flatten().to_numpy() for x in lists], np.concatenate(([0], np.cumsum(lists[0].value_lengths().to_numpy())))
        heads = sorted((r for r in rows if r["chunk"] < 0), key=lambda r: r["g"])
        place = {r["g"]: k for k, r in enumerate(heads)}
        block = np.array([r["g"] // block_size for r in heads])
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        value = np.zeros((len(heads), len(heads)), dtype=np.uint64)
        kept, lo = heads[0]["kept"], heads[0]["lo"]
        totals = [r["total"] + 2 * r["kept"] for r in heads]
        first = max(lo, strip * strip_terms)
        others = max(0, min(lo + kept, (strip + 1) * strip_terms) - first)  # the language's terms in the strip that no source here has

        def add(p: np.ndarray, times: int) -> None:
            for i in left.tolist():
                those = right[right > i] if low == high else right
                value[i, those] += divergence(p[i], p[those]).sum(axis=1, dtype=np.uint64) * np.uint64(times)

        at = len(heads)
        while at < len(rows):
            stop, chunk = at, rows[at]["chunk"]
            while stop < len(rows) and rows[stop]["chunk"] == chunk:
                stop += 1
            places, found = (x[cuts[at] : cuts[stop]] for x in flat)
            used, column = np.unique(places, return_inverse=True)
            counts = np.zeros((len(heads), len(used)), dtype=np.int64)
            counts[np.repeat([place[r["g"]] for r in rows[at:stop]], np.diff(cuts[at : stop + 1])), column] = found
            add(np.stack([shares(c, total) for c, total in zip(counts, totals, strict=True)]), 1)
            others -= len(used)
            at = stop
        if others:
            add(np.stack([shares(np.zeros(1, dtype=np.int64), total) for total in totals]), others)
        i, j = (x.reshape(-1) for x in np.meshgrid(left, right, indexing="ij"))
        if low == high:
            i, j = i[i < j], j[i < j]
        names = pa.array([r["source"] for r in heads], type=pa.string())
        ends, values = [names.take(pa.array(x)) for x in (i, j)], pa.array(value[i, j].astype(np.int64))
        both = [pa.concat_arrays([ends[0], ends[1]]), pa.concat_arrays([ends[1], ends[0]]), pa.concat_arrays([values, values])]
        return pa.table([pa.array([lang], type=pa.string()).take(pa.array(np.zeros(2 * len(i), dtype=np.int32))), *both], names=["lang", "source", "item", "value"])

    return run


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, ranks: int = MOST_RANKS,
    block: int = BLOCK, chunk: int = CHUNK, strip: int = STRIP,
) -> DataFrame:
    """(lang, source, part, item, value, rank) for each (lang, source) that occurs.

    Part ``pair`` has a row for each other source of the language, with the sum of the divergence over all terms that are in at least ``least_docs``
    documents of the language. Part ``term`` has the ``ranks`` kept terms whose share in the source is most above that in
    the language. Ranks go from 1, greatest value first, equals by UTF-8. Null texts, languages and sources are ''. A source of a language alone
    has no pairs, one without kept terms no terms; a language without kept terms has pairs of value 0. Repeated rows count as often as they
    come, further columns are ignored, and an empty table gives no rows. Text lengths do not matter; a group of a third of all
    rows is counted in all tasks.
    """
    counts = materialize(count_terms(docs, text_col, lang_col, source_col), "terms")
    # Terms are numbered, each language's one after the other.
    good = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    terms = materialize(with_position(good.select("lang", "term", "all_n").orderBy("lang", "term"), "no"), "kept")
    by_lang = terms.groupBy("lang").agg(F.min("no").alias("lo"), F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    hits = materialize(counts.where("n > 0").join(terms, ["lang", "term"]).select("lang", "source", "no", "n", "all_n"), "hits")
    totals = hits.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = with_position(counts.where("term is null").select("lang", "source").orderBy("lang", "source"), "at").join(totals, ["lang", "source"], "left")
    firsts = groups.groupBy("lang").agg(F.min("at").alias("first"), F.count("*").alias("sources"))
    groups = groups.join(firsts, "lang").join(by_lang, "lang", "left").select(
        "lang", "source", (F.col("at") - F.col("first")).alias("g"), "sources",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "kept", "lo", "all_total")),
    )
    groups = materialize(groups, "groups")
    release(counts)
    pairs = _pair_rows(hits, groups, block, chunk, strip)
    found = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))
    best = _term_rows(hits, groups, ranks).join(terms.select("no", F.col("term").alias("item")), "no").withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return found.select(columns).unionByName(best.select(columns))


def _pair_rows(hits: DataFrame, groups: DataFrame, block: int, chunk: int, strip: int) -> DataFrame:
    """(lang, source, item, value) of every pair of sources of a language, from both sides."""
    packed = hits.withColumn("chunk", F.expr(f"no div {chunk}")).groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("no", "n")).alias("x"))
    packed = packed.join(groups, ["lang", "source"]).withColumn("strip", F.expr(f"chunk div {strip}"))
    packed = packed.withColumns({"places": F.expr("transform(x, y -> y.no)"), "counts": F.expr("transform(x, y -> y.n)")}).drop("x")
    # Each source is in each strip of its language, also where it has none of the terms.
    size = chunk * strip
    empty = F.array().cast("array<long>")
    heads = groups.withColumns({"chunk": F.lit(-1).cast("long"), "strip": F.explode(F.expr(f"sequence(lo div {size}, greatest(lo, lo + kept - 1) div {size})")), "places": empty, "counts": empty})
    rows = packed.unionByName(heads).withColumn("block", F.expr(f"g div {block}"))
    tiles = rows.withColumn("other", F.explode(F.expr(f"sequence(0L, (sources - 1) div {block})"))).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    parts = tiles.drop("block", "other", "sources", "all_total").groupBy("lang", "strip", "low", "high").applyInArrow(_tile(block, size), _PAIRS_DDL)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _term_rows(hits: DataFrame, groups: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, no, value, rank) of the terms whose share is above that in the language."""
    share = "1 + (cast({} + 2 as decimal(20, 0)) * {}BD) div cast({} + 2 * kept as decimal(20, 0))"
    found = hits.join(groups, ["lang", "source"]).withColumns({"p": F.expr(share.format("n", ONE, "total")), "q": F.expr(share.format("all_n", ONE, "all_total"))})
    found = found.where("p > q").withColumn("value", F.expr("((p - q) * (p - q)) div (p + q)"))
    # Terms are numbered in the order of their bytes.
    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "no"))
    return found.withColumn("rank", best).where(F.col("rank") <= ranks).select("lang", "source", "no", "value", "rank")
