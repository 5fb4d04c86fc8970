import random
import zlib

import numpy as np
from tests.llm.fixtures import table

from leafsieve.llm import language_id as li
from leafsieve.llm.queries import op1_language_id


def brute_phrases(text, sample):
    """Greedy longest matches by substring search over the whole text."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        count, at = count + 1, at + size
    return count


def coded(text):
    return np.frombuffer(text.encode(), dtype=np.uint8).astype(np.int64) - 96


def test_phrases_equal_substring_search(monkeypatch):
    """Also where matches are longer than stretches, and where stretches never fall in with one another."""
    rng = random.Random(2)
    for stretch, before, rounds in ((512, 48, 4), (16, 4, 4), (16, 4, 0), (7, 2, 1)):
        for name, value in (("STRETCH", stretch), ("BEFORE", before), ("ROUNDS", rounds)):
            monkeypatch.setattr(li, name, value)
        for turn in range(12):
            sample = "".join(rng.choice("abc") for _ in range(rng.randint(1, 200))) if turn else "a" * 50
            machine = li.automaton(coded(sample), 8)
            assert len(machine.base) <= 2 * len(sample) + 1
            texts = ["".join(rng.choice("abcd") for _ in range(rng.choice([0, 1, 30, 200, 700]))) for _ in range(9)] + [sample * 3, "a" * 1000, "ab" * 300 + "d"]
            assert li.phrases([coded(t) for t in texts], machine).tolist() == [brute_phrases(t, sample) for t in texts]


def test_automaton_has_the_substrings():
    rng = random.Random(5)
    for size, alphabet in ((60, 3), (300, 250), (400, 5000)):
        codes = np.array([rng.randrange(1, alphabet) for _ in range(size)])
        machine = li.automaton(codes, alphabet)
        inside = {tuple(codes[i : i + n]) for n in (1, 2, 3) for i in range(size)}
        for part in [*inside, *((rng.randrange(alphabet), rng.randrange(alphabet)) for _ in range(300))]:
            state = np.zeros(1, dtype=np.int64)
            for c in part:
                state = machine.step(state, np.array([c])) if state[0] >= 0 else state
            assert (state[0] >= 0) == any(tuple(codes[i : i + len(part)]) == tuple(part) for i in range(size))


def test_every_letter_and_label_is_learned(spark):
    """Scripts of thousands of letters, and more labels than any list of languages had; short texts fill the sample."""
    rng = random.Random(4)
    pools = {f"l{k}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(260)}
    rows = [(i, "".join(rng.choice(pool) for _ in range(30)), lang) for lang, pool in pools.items() for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.fit(docs)
    assert model.langs == sorted(pools) and len(set(model.letters.tolist())) > 9000
    told = {lang: "".join(t for _, t, k in rows if k == lang) for lang in pools}
    langs, _ = li.predict(model, list(told.values()))
    assert langs == list(pools)
    short = spark.range(40_000).selectExpr("id as doc_id", "concat('wort', id % 1000, ' satz') as text", "'de' as lang")
    assert li.SAMPLE <= sum(len(r.text) for r in li.sample(short, "doc_id", "text", "lang").collect()) <= li.SAMPLE + li.EACH


def test_query_equals_brute_force(spark):
    """Whole texts of the table, phrases by substring search in the samples."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labelled = docs.where(~li.held_out())
    parts = {}
    for r in sorted(li.sample(labelled, "doc_id", "text", "lang").collect(), key=lambda r: (r.lang, r.n)):
        parts.setdefault(r.lang, []).append(r.text)
    plain = lambda t: " ".join("".join(c if c.isalpha() else " " for c in (t or "").lower()).split())
    joined = {k: " ".join(map(plain, v))[: li.SAMPLE] for k, v in parts.items()}
    learned = {k: t[: len(t) * 3 // 4] for k, t in joined.items()}
    rate = {k: brute_phrases(t[len(t) * 3 // 4 :], learned[k]) / (len(t) - len(t) * 3 // 4) for k, t in joined.items()}
    norm = {k: (v / np.mean(list(rate.values()))) ** 0.5 for k, v in rate.items()}
    got = {r.doc_id: r for r in op1_language_id(spark, "/root/testdata/sf0.001").collect()}
    rows = docs.collect()
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        text = plain(r.text)
        need = sorted((brute_phrases(text, learned[k]) / norm[k], k) for k in learned)
        if text:
            assert got[r.doc_id].lang_pred == need[0][1] or abs(need[0][0] - need[1][0]) < 1e-9
            assert abs(got[r.doc_id].score - (1 - need[0][0] / need[1][0])) < 1e-9
        else:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)


def test_cases(spark):
    en = "the quick brown fox jumps over the lazy dog and then it runs away from the hound "
    de = "der schnelle braune fuchs springt über den faulen hund und läuft dann davon "
    docs = table(spark, [en * 3, de * 3, None, "", " 12!", "über den faulen hund", "THE LAZY DOG", "x" * 200_000, "日本語", en * 3], ["en", "de", None, None, None, None, None, None, None, "en"])
    model = li.fit(docs)
    got = [(r.language.lang, r.language.score) for r in li.identify(docs, model).orderBy("doc_id").collect()]
    assert [g[0] for g in got[:7]] == ["en", "de", "und", "und", "und", "de", "en"]
    assert all(0 <= g[1] <= 1 for g in got) and got[8][0] in ("de", "en") and got[0] == got[9]
    assert li.identify(docs.limit(0), model).count() == 0
    nothing = li.fit(docs.where("lang is null"))
    assert {r.language.lang for r in li.identify(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    rows = op1_language_id(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
