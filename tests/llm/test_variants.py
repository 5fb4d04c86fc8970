import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import SCHEMA

from leafsieve.llm.queries import ORACLE_SQL, QUERIES
from leafsieve.llm.variants import count_words, group_variants, near_words

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def is_near(a, b):
    """By the first and the last letters that agree."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    short = min(len(a), len(b))
    head = next((k for k in range(short) if a[k] != b[k]), short)
    tail = next((k for k in range(short) if a[-1 - k] != b[-1 - k]), short)
    return head + tail >= (short if len(a) != len(b) else short - 1)


def brute(rows):
    n = brute_words(rows)
    near = defaultdict(set)
    listed = sorted(n, key=len)
    for k, a in enumerate(listed):
        for b in listed[k + 1 :]:
            if len(b) > len(a) + 1:
                break
            if is_near(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def got(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, 0, "own", 1) for i, t in rows], SCHEMA)
    df = df.withColumns({c: F.lit(3) for c in ("word", "n", "key", "half", "form", "root")}).repartition(3)
    found = [tuple(r) for r in group_variants(df).select(COLUMNS).collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['op13_spelling_variants']})").fetchall()
    rows = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).select(COLUMNS).collect()]
    assert sorted(map(repr, want)) == sorted(map(repr, rows))
    assert len(rows) > 50 and any(r[1] for r in rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [tuple(r) for r in QUERIES["op13_spelling_variants"](spark, "/root/testdata/sf0.001").select(COLUMNS).collect()]
    assert set(rows) == brute([tuple(d) for d in docs])


def test_chains_ties_and_letters(spark):
    rng, rows = random.Random(4), []

    def say(word, times):
        rows.extend((len(rows) + k, f"{word}-") for k in range(times))

    # A chain of four words, each five times as often; ties of forms; letters of two bytes; signs within words.
    for word, times in (("abcdef", 700), ("abcdeg", 190), ("abcdegh", 35), ("abcdeghi", 6), ("éabcdeÿ", 40), ("èabcdeÿ", 40), ("abcdeÿ", 6), ("x×y÷zab", 50), ("x×y÷za", 9)):
        say(word, times)
    say("fedcba", 300)  # the same letters in another order
    say("ABCDEFÉ", 7)
    for _ in range(400):  # words of few letters, so that keys meet often
        say("".join(rng.choice("ab") for _ in range(rng.randint(6, 8))), rng.randint(1, 12))
    rows += [(None, "nullid " * 6), (10**6, None), (10**6 + 1, ""), (10**6 + 2, "abcdef " * 3000), (10**6 + 2, "日abcdef本 İabcdef"), (7, "ab cd"), (8, "z" * 40_000)]
    rows += [(9, "z" * 40_000)] * 5 + [(9, "z" * 39_999)] * 30
    want = brute(rows)
    assert got(spark, rows) == want
    assert max(sum(1 for _ in chain(w, {r[0]: r[1] for r in want})) for w in (r[0] for r in want)) >= 3


def chain(word, form):
    while form[word]:
        word = form[word]
        yield word


def test_near_words_of_dense_sets(spark):
    """All words of few letters: every bucket is full, and each pair is found once."""
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(700)} | {w * 3 for w in ("ab", "ba", "éé")})
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "word string, n long")
    pairs = [tuple(sorted((r.a, r.b))) for r in near_words(df).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if a < b and is_near(a, b)}


def test_words_are_handed_on_and_long_texts_are_cut(spark, monkeypatch):
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k % 7)}xy" for k in range(3000))
    df = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string").coalesce(1)
    once, often = (sorted(map(tuple, count_words(df, at_once=n).collect())) for n in (10**6, 5))
    assert once == often and sum(n for _, n in once) == 60_000
    assert {w: n for w, n in once if len(w) >= 6} == {w: n for w, n in brute_words([(k, text) for k in range(20)]).items()} | {w: n for w, n in once if n < 5}


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert group_variants(df).count() == 0 and group_variants(df).columns == COLUMNS
    assert group_variants(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        group_variants(df, times=1)
