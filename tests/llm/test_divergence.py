import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.fixtures import SCHEMA

from leafsieve.llm.divergence import ONE, count_terms, shares, source_divergence
from leafsieve.llm.divergence import divergence as apart
from leafsieve.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10, ranks=10):
    """Rows (text, lang, source) by the definition."""
    docs = [([t.translate(LOWER) for t in TERM.findall(text or "")], lang or "", source or "") for text, lang, source in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        own = [d for d in docs if d[1] == lang]
        df = Counter(t for terms, _, _ in own for t in set(terms))
        kept = sorted(t for t, n in df.items() if n >= least)
        count = {s: Counter(t for terms, _, of in own if of == s for t in terms) for s in {d[2] for d in own}}
        whole = sum(count.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + ONE * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(c) for s, c in count.items()}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, None), ("term", term, ranks)):
                for k, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    out.add((lang, s, part, item, value, k + 1))
    return out


def got(spark, rows, **options):
    df = spark.createDataFrame([(k, *r, 0, "own", 1) for k, r in enumerate(rows)], SCHEMA)
    df = df.withColumns({c: F.lit(3) for c in ("term", "n", "g", "chunk", "total", "item")}).repartition(3)
    found = [tuple(r) for r in source_divergence(df, **options).collect()]
    assert len(found) == len(set(found))
    return set(found)


def made(seed, rows, sources, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abÉéñ") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return [
        (rng.choice([" ", "-", "\n", "1"]).join(rng.choice(vocabulary) if rng.random() < 0.8 else rng.choice(vocabulary).upper() for _ in range(rng.randint(0, 30))),
         rng.choice(["en", "de"]), f"s{rng.randrange(sources)}")
        for _ in range(rows)
    ]


def test_query_equals_sql(spark):
    """At sf0.001; the driver compares at sf0.01."""
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    want = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL['op12_source_divergence']})").fetchall()
    result = QUERIES["op12_source_divergence"](spark, sf)
    assert sorted(want) == sorted(tuple(r) for r in result.select(columns).collect())
    assert dict(result.dtypes)["value"] == "bigint" and dict(result.dtypes)["rank"] == "int"


@pytest.mark.parametrize("sizes", [(16, 8192, 8), (2, 3, 2), (1, 1, 1), (3, 5, 1)])
def test_equals_definition_under_any_tiles(spark, sizes):
    """Blocks, chunks and strips of any size, borders between languages inside them, give the same rows."""
    rows = made(1, 120, 7)
    assert got(spark, rows, **dict(zip(("block", "chunk", "strip"), sizes, strict=True))) == brute(rows)


def test_terms_are_handed_on(spark):
    """A task that may hold few terms counts the same."""
    rows = made(3, 40, 3)
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    once, often = (sorted(map(repr, count_terms(df, at_once=n).collect())) for n in (10**6, 5))
    assert once == often


def test_awkward_rows(spark):
    rows = [
        *[("shared words Here \u00c9\u00e9", "en", s) for s in "abc" for _ in range(4)], *[("shared words Here \u00c9\u00e9", "en", "a")] * 9,
        ("shared " * 50_000, "en", "long"), (None, "en", "no text"), ("", "en", "empty"), ("1234 -- \x7f", "en", None), ("rare rare", "en", "rare"),
        ("only one", "fr", "x"), ("only two", "fr", "y"), (None, "it", "alone"), (None, None, None), ("a null language", None, "s"),
    ]
    want = brute(rows)
    assert got(spark, rows) == want
    # A language without kept terms has pairs of value 0, a source alone no rows.
    assert {r for r in want if r[0] == "fr"} == {("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)}
    assert not [r for r in want if r[0] == "it"]
    assert got(spark, rows, least_docs=1, ranks=2) == brute(rows, 1, 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = source_divergence(df)
    assert out.count() == 0 and out.columns == ["lang", "source", "part", "item", "value", "rank"]


def test_arithmetic_is_exact():
    rng = random.Random(2)
    for _ in range(300):
        total = rng.choice([5, 10**6, 10**12, 9 * 10**15]) + rng.randrange(1, 1000)
        counts = np.array([0, 1, total // 3, total - 2, rng.randrange(total)])
        assert shares(counts, total).tolist() == [1 + ONE * (int(c) + 2) // total for c in counts]
    p, q = (np.array([rng.randrange(1, ONE + 2) for _ in range(2000)] + [1, ONE + 1], dtype=np.uint64) for _ in range(2))
    assert apart(p, q).tolist() == [(a - b) ** 2 // (a + b) for a, b in zip(p.tolist(), q.tolist(), strict=True)]
