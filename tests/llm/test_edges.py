"""Every operator and stage on null columns, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leafsieve.llm import chat_format, exact_dedup, language_id, merge_dropout, packing, pii, quality, simhash, suffix_dedup, token_counts

BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Names that operators use inside.
CLASHES = ("fp", "rep", "digest", "points", "keep_id", "h", "doc", "at", "runs", "marks", "made", "part", "ids", "kept", "component_id", "shard", "level", "start")


def docs(spark):
    long = "long words of a very long text " * 9000
    rows = [
        (0, "some words that repeat " * 30, "en", "s", 5), (0, "some words that repeat " * 30, "en", "s", 5), (1, None, None, None, None), (2, "", "en", "s", 0),
        (3, long, "de", "s", 1), (4, long, None, "s", 1), (None, "a text without an id", "en", "s", 1), (None, None, None, None, None), (5, " \n\t", "fr", "s", 3),
        (6, "x" * 70_000, "fr", "s", 3), (7, "𝄞é\u0000▁ ▁", "fr", "s", 3),
    ]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return out.withColumns({c: F.lit("clash") for c in CLASHES})


def frame_of(name):
    def model(df):
        return language_id.identify(df, language_id.fit(df))

    return {
        "language": model,
        "suffix": suffix_dedup.remove_repeats,
        "dropout": lambda df: merge_dropout.decode_pieces(merge_dropout.encode_pieces(df, PIECES), PIECES, out_col="back"),
        "counts": lambda df: token_counts.count_tokens(df, PIECES),
        "exact": exact_dedup.exact_dedup,
        "pii": pii.find_pii,
        "simhash": simhash.simhash_dedup,
        "quality": quality.annotate_quality,
        "packing": lambda df: packing.pack(df, BPE),
        "chat": lambda df: chat_format.format_chats(df, "doc_id", "n_chars", "lang", "text"),
    }[name]


NAMES = ["language", "suffix", "dropout", "counts", "exact", "pii", "simhash", "quality", "packing", "chat"]
PER_ROW = {"language", "suffix", "dropout", "counts", "exact", "pii", "simhash", "quality"}


@pytest.mark.parametrize("name", NAMES)
def test_operator(spark, name):
    df, run = docs(spark), frame_of(name)
    rows = run(df).collect()
    if name in PER_ROW:
        assert len(rows) == df.count()
    # Each row keeps its own document, and equal rows get equal answers.
    ids = [r.conv_id if name == "chat" else r.doc_id for r in rows]
    assert set(ids) == {0, 1, 2, 3, 4, 5, 6, 7, None}
    if name in PER_ROW:
        twins = [r for r in rows if r.doc_id == 0]
        assert twins[0] == twins[1]
    # The order and the dealing of the rows do not matter.
    if name != "packing":
        other = run(df.orderBy(F.desc("n_chars")).repartition(5)).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, other))
    assert run(df.limit(0)).count() == 0
    assert run(df.limit(0)).columns == run(df).columns


@pytest.mark.parametrize("name", NAMES)
def test_only_nulls(spark, name):
    df = docs(spark).where("doc_id = 1 or doc_id is null").withColumn("text", F.lit(None).cast("string"))
    rows = frame_of(name)(df).collect()
    assert rows and (name not in PER_ROW or len(rows) == 3)


@pytest.mark.parametrize("stage", range(5))
def test_stage(spark, stage):
    name, run = corpus_pipeline.STAGES[stage]
    df = docs(spark)
    rows = run(spark, df, "/nowhere").collect()
    if stage < 4:
        assert run(spark, df, "/nowhere").dtypes == df.dtypes
        assert {r.doc_id for r in rows} <= {0, 1, 2, 3, 4, 5, 6, 7, None}
        assert all(r.fp == "clash" for r in rows)
    assert run(spark, df.limit(0), "/nowhere").count() == 0


def test_ties(spark):
    """Equal texts, lengths and lines: the smallest id stays; equal scores go to the first language by name."""
    df = spark.createDataFrame([(i, "same text", ("b", "a")[i % 2]) for i in (9, 3, 5)], "doc_id long, text string, lang string")
    assert {r.keep_id for r in exact_dedup.exact_dedup(df).collect()} == {3}
    assert {r.component_id for r in simhash.simhash_dedup(df).collect()} == {3}
    assert {r.language.lang for r in language_id.identify(df, language_id.fit(df)).collect()} == {"a"}
