"""Small helpers for operators that work on texts in Python workers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Bytes of text that a worker handles at once; longer texts are handled alone.
SLICE_BYTES = 1 << 20
#: Entries of one generation of a WordCache.
CACHE_WORDS = 400_000

#: [\x20\x09-\x0D] as a table over bytes.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def slices(texts: Sequence[str | bytes | None], limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as UTF-8 (null: empty), of about ``limit`` bytes each, with the place of the first."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        data = b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass")
        if held and size + len(data) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(data)
        size += len(data)
    if held:
        yield first, held


def tidy() -> None:
    """Give back memory that the allocators of Arrow and C hold but do not use; workers live on and share a machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordCache:
    """What is known of a word, for words that come again; two generations bound the memory.

    ``compute`` maps a list of words to a list of values. Words over ``longest`` bytes are
    computed each time and not kept.
    """

    def __init__(self, compute: Callable[[list], list], limit: int = CACHE_WORDS, longest: int = 64):
        self.compute, self.limit, self.longest = compute, limit, longest
        self.young: dict = {}
        self.old: dict = {}

    def each(self, words: list) -> list:
        """The value of each word, in order."""
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        out = list(map(self.young.get, words))
        gaps = [i for i, value in enumerate(out) if value is None]
        if gaps:
            known = self.values([set(map(words.__getitem__, gaps))])
            for i in gaps:
                out[i] = known[words[i]]
        return out

    def values(self, lists: Iterable[Iterable]) -> dict:
        """A mapping that has every word of ``lists``; good until the next call."""
        need = set().union(*lists)
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = need.difference(young)
        if not missing:
            return young
        again = list(filter(old.__contains__, missing))
        young.update(zip(again, map(old.__getitem__, again), strict=True))
        new = list(missing.difference(again))
        if not new:
            return young
        values = self.compute(new)
        if max(map(len, new)) <= self.longest:
            young.update(zip(new, values, strict=True))
            return young
        long = {}
        for word, value in zip(new, values, strict=True):
            (long if len(word) > self.longest else young)[word] = value
        return {w: long[w] if w in long else young[w] for w in need}
