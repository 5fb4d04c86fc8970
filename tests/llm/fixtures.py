"""Small tables of documents that hold the awkward cases."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, extra int"


def table(spark, texts, langs=None):
    """Documents with ids from 0, two columns whose names clash with ones inside the operators."""
    rows = [(i, t, (langs[i] if langs else None), "s", None if t is None else len(t), "own", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
