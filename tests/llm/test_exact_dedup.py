import hashlib
import re

from tests.llm.fixtures import table

from leafsieve.llm.exact_dedup import exact_dedup, keep_distinct


def brute(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub("[ \t-\r]", "", t or ""), []).append((-len(t or ""), i))
    return {
        i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g
    }


def test_equals_brute_force(spark):
    texts = [None, "", " ", "a b", "ab", "a  b", "AB", "é", " ", "𝄞 x", "𝄞x", "long " * 30_000] + ["hot copy"] * 400 + ["hotcopy"]
    texts += [f"only {i}" for i in range(300)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(table(spark, texts)).collect()}
    assert got == brute(texts)
    assert {r.doc_id for r in keep_distinct(table(spark, texts)).collect()} == {i for i, v in brute(texts).items() if v[2]}


def test_empty_and_null_ids(spark):
    docs = table(spark, ["a"])
    assert exact_dedup(docs.limit(0)).count() == 0
    nulls = docs.selectExpr("cast(null as long) doc_id", "text").unionByName(docs.select("doc_id", "text"))
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(nulls).collect()} == {(None, 0, False), (0, 0, True)}


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_rows_are_kept_by_row(spark):
    """Ids that repeat with another text, null ids, and rows that repeat: one of each group stays and nothing else goes."""
    rows = [(1, "alpha  text"), (2, "only here"), (2, "alpha text"), (None, "alpha text"), (None, "by itself"), (None, "by itself"), (3, "twice"), (3, "twice"), (3, "t wice"), (4, None), (5, " ")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = keep_distinct(docs.repartition(3))
    assert got.columns == docs.columns
    assert kept(got) == sorted([(1, "alpha  text"), (2, "only here"), (3, "t wice"), (None, "by itself"), (5, " ")], key=str)
    hot = spark.range(3000).selectExpr("cast(7 as long) as doc_id", "'copy' as text", "id % 2 as other")
    assert [(r.doc_id, r.text) for r in keep_distinct(hot).collect()] == [(7, "copy")]
