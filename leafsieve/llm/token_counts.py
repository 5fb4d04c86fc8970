"""Token counts without tokens: count-only Viterbi over unigram pieces.

An Aho-Corasick automaton names every piece that ends at a place; the best score and the
number of pieces are carried from place to place, and no path is kept. Ties go as in the
tokenizer: of paths with equal scores to one place, the one with the longest last piece
stays. No piece crosses from one word or line to the next, so words are counted apart and
those that come again are remembered.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.textwork import WordCache, tidy
from leafsieve.llm.vocabulary import SPACE, load_vocabulary, unigram_scores, units
from leafsieve.runtime import ship

#: What the tokenizer takes off the lowest score for an unknown letter, in 64ths.
UNKNOWN_PENALTY = 640


class Counter:
    """Counts the pieces of texts under one vocabulary. ``scores`` are by id, in 64ths."""

    def __init__(self, pieces: dict[str, int], scores: list[int], prefix: bool):
        self.prefix = prefix
        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():
            self.automaton.add_word(piece, (len(piece), scores[i]))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(scores[i] for i in pieces.values()) - UNKNOWN_PENALTY
        self.cache = WordCache(lambda words: [self.unit(w) for w in words])

    def unit(self, text: str) -> int:
        """The number of pieces of a unit, plus 2**40 times the score taken off."""
        best: list[int | None] = [0] + [None] * len(text)
        count = [0] * (len(text) + 1)
        place = 0  # before it, every place has its best
        for end, (size, score) in self.automaton.iter(text):
            while place < end:
                self._single(text, place, best, count)
                place += 1
            # Pieces that end here come with the longest first.
            start = end + 1 - size
            candidate = best[start] + score
            if best[end + 1] is None or candidate > best[end + 1]:
                best[end + 1], count[end + 1] = candidate, count[start] + 1
        while place < len(text):
            self._single(text, place, best, count)
            place += 1
        return count[-1] + (-best[-1] << 40)

    def _single(self, text: str, place: int, best: list, count: list) -> None:
        """A letter that is no piece of its own may be passed as bytes."""
        letter = text[place]
        if letter not in self.single:
            candidate = best[place] + self.unknown
            if best[place + 1] is None or candidate > best[place + 1]:
                best[place + 1], count[place + 1] = candidate, count[place] + len(letter.encode("utf-8", "surrogatepass"))

    def count(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, score) of each text."""
        split = [units(t.replace(SPACE, " "), self.prefix) if t else [] for t in texts]
        known = self.cache.values(split)
        sums = [sum(map(known.__getitem__, u)) for u in split]
        return np.array([s & ((1 << 40) - 1) for s in sums], dtype=np.int64), np.array([-(s >> 40) / 64 for s in sums])


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter for a worker, with what it knows of words from earlier tasks."""
    if path not in _counters:
        vocabulary = load_vocabulary(path)
        _counters[path] = Counter(vocabulary.pieces, unigram_scores(vocabulary.scores), vocabulary.prefix)
    return _counters[path]


_RESULT = pa.struct([("n_tokens", pa.int64()), ("score", pa.float64())])


def count_tokens(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "tokens") -> DataFrame:
    """``docs`` with a struct of n_tokens and the score of the best segmentation.

    A null or empty text has no token and score 0; texts are counted whole, an unknown letter as its bytes.
    Other columns stay as they are; one named ``out_col`` is replaced. Repeated rows are counted alike,
    an empty table stays empty.
    """

    def run(texts: pa.Array) -> pa.Array:
        held = texts.to_pylist()
        parts = [counter(model_path).count(held[k : k + 256]) for k in range(0, len(held), 256)]
        n, score = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64), np.zeros(0))
        tidy()
        return pa.StructArray.from_arrays([pa.array(n), pa.array(score)], fields=list(_RESULT))

    ship(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(run, "struct<n_tokens: bigint, score: double>")(F.col(text_col)))
