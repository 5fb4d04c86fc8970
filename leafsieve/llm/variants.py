"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so it does not depend on their order. Words that differ by one
inserted, deleted or replaced letter have keys that differ by the value of a letter, or by the difference of two. Either way
the keys meet when a letter's value is taken off the longer word, or off both. So each word is dealt out under its own key and under its key
less each of its letters, and these are joined by equality. No two sums of two fifth powers in the range
are equal, so a pair of words meets under one key only.

Words of the same letters in another order would meet as well, and might be many. A word with one edit keeps one of its halves. So
words also agree on the first or the last half, and what meets is verified by the edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.textwork import slices, tidy
from leafsieve.runtime import materialize, measured, release, ship

#: Code points of a word, its occurrences, and how many times as often its form comes.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
#: One of so many runs of a document loses a letter.
SLIPS = 199
#: Words that a task counts before it hands them on, and bytes of one text that are split at once.
AT_ONCE, STRETCH = 400_000, 1 << 22
#: The value of a letter is the POWER-th power of its place in the alphabet, counted from FIRST.
POWER, FIRST = 5, 100

#: [A-Za-zÀ-ÿ] over ISO 8859-1, in which each code point up to U+00FF is a byte; the rest parts words. Only A-Z are lower-cased.
_LETTERS = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0xC0 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_VALUE = np.zeros(256, dtype=np.int64)
_VALUE[[*range(0x61, 0x7B), *range(0xC0, 0x100)]] = np.arange(FIRST, FIRST + 26 + 64, dtype=np.int64) ** POWER

_WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
_KEYS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("key", pa.int64()), ("half", pa.int64()), ("last", pa.bool_()), ("less", pa.bool_())])
_KEYS_DDL = "word string, n long, key long, half long, last boolean, less boolean"


def _split(text: bytes) -> list[bytes]:
    """The runs of a text as ISO 8859-1; what that has not becomes a question mark."""
    return text.decode("utf-8", "replace").encode("latin-1", "replace").translate(_LETTERS).split()


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text cut at spaces."""
    at = 0
    while len(text) - at > STRETCH and (cut := text.find(b" ", at + STRETCH)) >= 0:
        yield text[at:cut]
        at = cut
    yield text[at:]


def _count(at_once: int, least: int):
    """Counts words of ``least`` letters, after slips, where the texts are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            words = [w.decode("latin-1") for w in held]
            out = pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(held.values(), type=pa.int64())], schema=_WORDS)
            held.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, texts in slices(batch.column(1).cast(pa.binary()).to_pylist()):
                for k, text in enumerate(texts, first):
                    start = zlib.crc32(f"{ids[k]}:".encode())
                    for part in _parts(text):
                        runs = [r for r in _split(part) if len(r) >= least]
                        held.update(runs)
                        hashes = {r: zlib.crc32(r if r.isascii() else r.decode("latin-1").encode(), start) for r in set(runs)}
                        slips = [(r, h) for r, h in hashes.items() if not h % SLIPS]
                        if slips:
                            times = Counter(runs)
                            for word, h in slips:
                                at = h % len(word)
                                held[word] -= times[word]
                                if len(word) > least:
                                    held[word[:at] + word[at + 1 :]] += times[word]
                if len(held) > at_once:
                    yield rows()
                    tidy()
        yield rows()

    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, at_once: int = AT_ONCE) -> DataFrame:
    """(word, n) of the words of whole texts with ``least_letters`` letters; some runs have lost a letter."""
    ship(docs.sparkSession)
    given = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    counted = given.mapInArrow(_count(at_once, least_letters), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each key of a word, its own and those less a letter, and each half."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4096):
            part = batch.slice(first, 4096)
            at, key, half, last, less = [], [], [], [], []
            for k, word in enumerate(part.column(0).to_pylist()):
                data = word.encode("latin-1")
                own = int(_VALUE[np.frombuffer(data, dtype=np.uint8)].sum()) if len(data) > 64 else sum(map(_VALUES.__getitem__, data))
                keys = [own, *(own - _VALUES[b] for b in set(data))]
                for is_last in (False, True):
                    # Letters of what is left, and of its first half; the last half is counted from the end.
                    halves = []
                    for left in (len(data), len(data) - 1):
                        n = left // 2
                        text = data[len(data) - (left - n) :] if is_last else data[:n]
                        halves.append(zlib.crc32(text) << 24 | (left & 0xFFFF) << 1 | is_last)
                    key += keys
                    half += [halves[0], *[halves[1]] * (len(keys) - 1)]
                    less += [False, *[True] * (len(keys) - 1)]
                    last += [is_last] * len(keys)
                    at += [k] * len(keys)
            at = pa.array(at, type=pa.int32())
            columns = [part.column(0).take(at), part.column(1).take(at), *(pa.array(x, type=t) for x, t in ((key, pa.int64()), (half, pa.int64()), (last, pa.bool_()), (less, pa.bool_())))]
            yield pa.RecordBatch.from_arrays(columns, schema=_KEYS)


_VALUES = _VALUE.tolist()


def near_words(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each pair of ``words`` (word, n) that differ by exactly one letter inserted, deleted or replaced, once.

    Words are of the letters above, each in one row.
    """
    ship(words.sparkSession)
    # Dealt out before, as a table of few and long words may be one file.
    keyed = words.select("word", "n").repartition("word").mapInArrow(_keyed, _KEYS_DDL)
    keyed = materialize(keyed, "keyed")
    a = keyed.where("less").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "key", "half", "last")
    b = keyed.select(F.col("word").alias("b"), F.col("n").alias("b_n"), "key", "half", F.col("less").alias("b_less"))
    n = "(char_length(a) - 1) div 2"  # letters of the first half that a pair may share
    near = F.expr(f"(not b_less or a < b) and levenshtein(a, b, 1) = 1 and last = (left(a, {n}) <> left(b, {n}))")
    return a.join(b, ["key", "half"]).where(near).select("a", "a_n", "b", "b_n")


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, times: int = TIMES,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words that come ``least_count`` times in all texts.

    A word's form is the near word that comes most often (ties: the least by code points), if that comes ``times`` as often as the word;
    else form and form_n are null. The root is the word at the end of its forms, itself if it has none. Null texts have no words, an id
    that is null is hashed as an empty string, repeated rows count as often as they come, further columns are ignored, and an
    empty table gives no rows.

    A form comes ``times`` as often as its word, so chains of forms are short, and following them takes a few joins. Of a word that is a form
    there are no more near words than letters and places allow.
    """
    if times < 2:
        raise ValueError("a form comes at least twice as often as its words, or chains of forms might not end")
    counted = count_words(docs, id_col, text_col, least_letters).where(F.col("n") >= least_count)
    words, (most,) = measured(counted, "words", F.max("n"))
    pairs = near_words(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word")).alias("near")),
        F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("word")).alias("near")),
    )).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    high = F.col("near.n") * -1 >= F.col("n") * times
    forms = words.join(best, "word", "left").select(
        "word", F.when(high, F.col("near.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(high, -F.col("near.n")).alias("form_n"),
    )
    forms = materialize(forms, "forms")
    return _rooted(forms, most or 0, times, least_count)


def _rooted(forms: DataFrame, most: int, times: int, least_count: int) -> DataFrame:
    """Forms with the word at the end of each chain; each round doubles how far a link leads."""
    links = forms.where("form is not null").select("word", F.col("form").alias("root"))
    longest = log(max(most / max(least_count, 1), 1), times)  # links in a chain
    for _ in range(ceil(log2(longest + 1))):
        far = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        old, links = links, materialize(links.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root")), "links")
        release(old)
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
