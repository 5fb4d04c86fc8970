import re

import pytest
from tests.llm.fixtures import small, table

from leafsieve.llm import quality
from leafsieve.llm.quality import annotate_quality, keep_good, measure

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)

    def cover(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        hit = set()
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                hit |= set(range(i, i + n))
        return hit

    chars = sum(map(len, words))
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": dup,
        "n_repeat_words": len(cover(3)), **{f"covered_{n}": sum(len(words[i]) for i in cover(n)) / max(chars, 1) for n in quality.MOST_COVERED},
    }


CASES = [None, "", " \n\t", "a", "a b c a b c a b", "é 𝄞 é 𝄞 é 𝄞 x", "\nline one two\nline one two\n \n \nx", "# $$ <a> b|c", "a\x1cb\x85c\xa0d",
         "one two three four five six seven eight nine ten " * 3, "x" * 200_000, "a b c d e f g h i j k " * 40 + "end"]


def test_measures_equal_brute_force(spark):
    got = {r.doc_id: r.quality.asDict() for r in annotate_quality(table(spark, CASES * 2)).collect()}
    for i, t in enumerate(CASES * 2):
        want = brute(t)
        assert {k: got[i][k] for k in want} == pytest.approx(want), t
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])


def test_exact_when_ids_overflow(monkeypatch):
    texts = [t.encode() for t in ("a b c d a b c", " ".join(map(str, range(3000))) + " 1 2 3 1 2 3")]
    plain = measure(texts)
    import numpy as np

    words = np.array([0, 1 << 40, 5, 0, 1 << 40, 5, 7])
    ids = quality._window_ids(words, 3)
    assert ids[0] == ids[3] and len(set(ids.tolist())) == 4
    assert plain.n_repeat_words.tolist() == [6, brute(texts[1].decode())["n_repeat_words"]]


def test_whole_table_and_filter(spark):
    docs = small(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in annotate_quality(docs).select("doc_id", "quality").collect():
        want = brute(texts[r.doc_id])
        assert {k: r.quality[k] for k in want} == pytest.approx(want)
    kept = keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert annotate_quality(docs.limit(0)).count() == 0
