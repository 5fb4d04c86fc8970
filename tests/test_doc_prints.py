"""Fingerprints of documents whose words are counted where they lie."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest

from leafsieve.queries import DOCS
from leafsieve.sources import adapters


def _write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("at_once", [1, 7, 1 << 16])
def test_counts_over_slices(monkeypatch, at_once):
    """Rows that end within a slice, at its end, or have no words, as null or in no row at all."""
    monkeypatch.setattr(adapters, "_WORDS", at_once)
    rng = random.Random(3)
    rows = [None, [], *([rng.choice(["", "a", "é", "word", "other"]) for _ in range(n)] for n in (1, 7, 6, 1, 0, 30, 14)), None]
    for words in (rows, rows[2:5], [None, []], []):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int64()), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "words"])
        (out,) = adapters._count_bits([batch])
        got = pa.Table.from_batches([out]).to_pylist()
        for r, held in zip(got, words, strict=True):
            hashes = [int(hashlib.md5(w.encode()).hexdigest()[:16], 16) for w in held or ()]
            assert r["n"] == len(hashes)
            ones = [sum(h >> (63 - k) & 1 for h in hashes) for k in range(64)]
            assert [r[f"v{k}"] for k in range(32)] == [ones[k] + (ones[k + 32] << 32) for k in range(32)]


def test_equal_to_sql(spark, tmp_path):
    """Rows that share an id are one document for its fingerprint, and a page each; a text that is null is a place but no page, unless its id has another."""
    rows = [(1, "a", "one two  two"), (2, "a", ""), (3, "a", None), (4, "a", "Four\n four\tFOUR"), (5, "b", "x"), (5, "c", "y z"), (6, None, "w"), (7, "b", None), (7, "c", "v"), (None, "d", "u")]
    found = adapters.doc_pages(spark, _write(spark, tmp_path, rows))
    got = sorted((str(r.archive), r["index"], r["size"], r.width, r.content_sha, r.dhash % (1 << 64), r.flat) for r in found.collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"with {DOCS} select archive, index, size, width, content_sha, h, flat from page_facts").fetchall()
    assert got == sorted((str(r[0]), *r[1:]) for r in want)


def test_no_words_are_shuffled(spark, tmp_path):
    """What is dealt out is a row per document, not per word."""
    plan = adapters.doc_prints(spark, _write(spark, tmp_path, [(1, "a", "b c")]))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and "Generate" not in plan


def test_unshared_ids_equal_sql(spark, tmp_path):
    """Where no two rows share an id, a row without words is a place but no page, and so is one without an id."""
    rows = [(1, "a", "one two  two"), (2, "a", ""), (3, "a", None), (4, "a", "Four\n four\tFOUR"), (5, "b", "x"), (6, None, "w"), (7, "b", None), (8, "b", "y z"), (None, "d", "u"), (None, "e", "t")]
    found = adapters.doc_pages(spark, _write(spark, tmp_path, rows))
    got = sorted((str(r.archive), r["index"], r["size"], r.width, r.content_sha, r.dhash % (1 << 64), r.flat) for r in found.collect())
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(f"with {DOCS} select archive, index, size, width, content_sha, h, flat from page_facts").fetchall()
    assert got == sorted((str(r[0]), *r[1:]) for r in want)


def test_counts_are_shuffled_only_for_shared_ids(spark, tmp_path):
    """Else a fingerprint goes with its row, and the counts are neither kept nor dealt out."""
    for ids, counts in (((1, 2, None, None), False), ((1, 2, 2, None), True)):
        where = tmp_path / str(counts)
        found = adapters.doc_pages(spark, _write(spark, where, [(i, "a", f"w{k}") for k, i in enumerate(ids)]))
        assert ("hashpartitioning(doc_id" in found._jdf.queryExecution().executedPlan().toString()) == counts
