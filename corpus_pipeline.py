"""Corpus preparation: stages that each apply one operator to what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafsieve.llm.exact_dedup import keep_distinct
from leafsieve.llm.packing import pack
from leafsieve.llm.pii import redact
from leafsieve.llm.quality import keep_good
from leafsieve.llm.queries import tokenizer_path
from leafsieve.llm.simhash import keep_first
from leafsieve.runtime import load, materialize, release, scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for blanks one stays."""
    return keep_distinct(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked one stays."""
    return keep_first(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and the length follows the text."""
    out = redact(docs)
    return out.selectExpr(*(f"cast(char_length(text) as {t}) as n_chars" if c == "n_chars" else f"`{c}`" for c, t in docs.dtypes))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, with the ids."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: Fingerprints, rolling hashes and a tokenizer are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over the table ``documents``."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # what a stage cuts goes when its result is written, and so does its input
            done = keep(materialize(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
