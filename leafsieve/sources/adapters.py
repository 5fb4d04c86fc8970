"""The driver's tables as libraries of books and pages.

LINES: a document is a book and its lines that are not blank are the pages. DOCS: a source is a book
and its documents are the pages. VECS: a label is a book and its vectors are the pages.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafsieve.functions.hashing import content_digest, dhash_of_bits, from_hex16
from leafsieve.operators.ranking import with_position
from leafsieve.runtime import load, materialize, release

#: A line with fewer letters than this stands for a blank page.
FLAT_BELOW = 12


def _page(archive, index, size, width, sha, dhash, flat):
    """The columns of the fact table, in order."""
    return [
        archive.alias("archive"), F.concat(F.lit("p"), index.cast("string"), F.lit(".jpg")).alias("name"), index.cast("int").alias("index"),
        size.cast("long").alias("size"), width.cast("int").alias("width"), F.lit(10).alias("height"), sha.alias("content_sha"),
        dhash.alias("dhash"), flat.alias("flat"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("codecs"),
    ]


def _places(df: DataFrame, group: str, key: str) -> DataFrame:
    """``df`` with pos: the place of each row in its group, by ``key``. A group may hold most rows: they are sorted by ranges, and no task gets a group."""
    placed = with_position(df.orderBy(group, key), "all")
    firsts = placed.groupBy(group).agg(F.min("all").alias("first")).withColumnRenamed(group, "of")
    return placed.join(firsts, placed[group].eqNullSafe(firsts["of"])).select(*df.columns, (F.col("all") - F.col("first")).alias("pos"))


def line_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of LINES; the fingerprint is the first half of the MD5, so it is for threshold 0."""
    # Lines are numbered within their row: nothing is shuffled.
    lines = load(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("pos", "line")
    )
    archive = F.concat(F.lit("lib/shelf"), (F.col("doc_id") % 7).cast("string"), F.lit("/book"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".cbz"))
    return lines.select(*_page(
        archive, F.col("pos"), F.octet_length("line"), F.length("line"), content_digest(F.col("line")),
        from_hex16(F.substring(F.md5(F.col("line").cast("binary")), 1, 16)), F.length("line") < FLAT_BELOW,
    ))


#: Words whose bits are counted at once (64 bytes each).
_WORDS = 1 << 16


def _count_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without their last column, an array of words; instead their number and, for each bit, how many hashes of words have it.

    Two counts are in a number: of bit 63 - k, and 32 bits higher of bit 31 - k. A distinct word of a batch is hashed once.
    """
    for batch in batches:
        words = batch.column(batch.num_columns - 1)
        starts, n = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)))), batch.num_rows
        coded = words.flatten().cast(pa.binary()).dictionary_encode()
        hashes = np.frombuffer(b"".join(hashlib.md5(w).digest()[:8] for w in coded.dictionary.to_pylist()), dtype=np.uint64)  # bytes as they come, the highest first
        index, ones = coded.indices.to_numpy(), np.zeros((n, 64), dtype=np.int64)
        for low in range(0, len(index), _WORDS):
            high = min(low + _WORDS, len(index))
            first, stop = np.searchsorted(starts, low, side="right") - 1, np.searchsorted(starts, high, side="left")
            rows = np.arange(first, stop)[starts[first + 1 : stop + 1] > starts[first:stop]]
            bits = np.unpackbits(hashes[index[low:high]].view(np.uint8).reshape(-1, 8), axis=1)
            ones[rows] += np.add.reduceat(bits, np.maximum(starts[rows], low) - low, axis=0, dtype=np.int64)
        packed = ones[:, :32] + (ones[:, 32:] << 32)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.diff(starts)), *(pa.array(packed[:, k]) for k in range(32))], names=[*batch.schema.names[:-1], "n", *(f"v{k}" for k in range(32))],
        )


def _counted(docs: DataFrame, *columns: Column) -> DataFrame:
    """(doc_id, columns, n, v0 to v31) of the documents: what :func:`_count_bits` says of their words. No text is shuffled."""
    given = docs.select("doc_id", *columns, F.split(F.lower("text"), "[ \n\t\r]+").alias("words"))
    fields = [*given.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in ("n", *(f"v{k}" for k in range(32))))]
    return given.mapInArrow(_count_bits, T.StructType(fields))


def _majority() -> Column:
    """The fingerprint of a counted row."""
    ones = [F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)) for k in range(32)] + [F.shiftrightunsigned(f"v{k}", 32) for k in range(32)]
    return dhash_of_bits(F.array(*(2 * x > F.col("n") for x in ones)))


def _prints(counted: DataFrame) -> DataFrame:
    """(doc_id, dhash) of counted documents; rows that share an id are one document."""
    sums = counted.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.sum("n").alias("n"), *(F.sum(f"v{k}").alias(f"v{k}") for k in range(32)))
    return sums.select("doc_id", _majority().alias("dhash"))


def doc_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dhash) of the documents; a bit is set where more than half of the tokens' hashes have it."""
    return _prints(_counted(load(spark, sf_dir, "documents")))


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of DOCS, with the fingerprints of :func:`doc_prints`. Texts are read once, and what is shuffled is what was found of them.

    Counts of words are kept and shuffled only where rows share an id. Else a row's own are all, and its fingerprint goes with it.
    """
    docs = load(spark, sf_dir, "documents")
    facts = (F.octet_length("text").alias("size"), F.length("text").alias("width"), content_digest(F.col("text")).alias("sha"))
    counted, columns = _counted(docs, F.col("source"), *facts), ["doc_id", "source", "size", "width", "sha"]
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        found = materialize(counted.select(*columns, F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), _majority()).alias("dhash")), "facts")
        placed = _places(found, "source", "doc_id").where("dhash is not null")
        release(found)
    else:
        found = materialize(counted, "facts")
        placed = _places(found.select(*columns), "source", "doc_id").join(_prints(found), "doc_id")
    return placed.select(*_page(
        F.col("source"), F.col("pos"), F.col("size"), F.col("width"), F.col("sha"), F.col("dhash"), F.col("width") < FLAT_BELOW,
    ))


def vector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of VECS; a bit says whether a number is smaller than the next, around the end."""
    rising = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("embedding", (i + 1) % 64) > F.get("embedding", i))
    found = load(spark, sf_dir, "embeddings")
    return found.join(_places(found.select("label", "vec_id"), "label", "vec_id").drop("label"), "vec_id").select(*_page(
        F.concat(F.lit("label"), F.col("label").cast("string")), F.col("pos"), F.lit(256), F.lit(64), content_digest(F.col("vec_id").cast("string")),
        dhash_of_bits(rising), F.lit(False),
    ))


def archives_of(pages: DataFrame) -> DataFrame:
    """Books of a table of pages, with the columns of the table of archives."""
    return pages.groupBy("archive").agg(F.count("*").cast("int").alias("page_count"), F.sum("size").alias("size")).select(
        "archive", F.lit("zip").alias("kind"), "size", F.lit(0).cast("long").alias("mtime_ns"), "page_count", F.lit(None).cast("string").alias("error"),
        F.lit("").alias("series"), F.lit("").alias("number"), F.lit("").alias("title"),
    )
