"""Ids of texts under a tokenizer file, for operators that want ids as little-endian 32-bit bytes.

A tokenizer of the form _BY_WORDS lowers the case and drops white space, and no merge, normal form or pattern
crosses that. So the ids of a text are those of its tokens in order. Tokens of many texts are found, looked up and
merged by array operations; what is unknown is merged in step and remembered. Any other tokenizer encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np

from leafsieve.llm.agendas import NONE, WIDTHS, PairTable, in_step
from leafsieve.llm.textwork import WordCache

#: The normal form and the pattern of a tokenizer whose ids can be found word by word. Fixed values.
_BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: Bytes of a token that the table can hold, slots of the table, and tokens in it before it is begun anew.
LANES = 3
SLOTS_BITS, MOST = 20, 600_000
#: Bytes of one text that are worked off at once, and words of other scripts that are remembered.
STRETCH, OTHERS = 1 << 22, 50_000

# What a byte is: white space, part of a letter, a digit, another mark, or part of what the library must see.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0x21:0x7F] = _MARK
_KIND[[0x20, *range(0x09, 0x0E)]] = _BLANK
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
#: U+00C0 to U+00FF are 0xC3 and a byte from 0x80 to 0xBF; two of these are signs, and the first half but one of them capitals.
_SIGNS = (0x97, 0xB7)
_HASH = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_CUT = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, … of each run of ``count``, one run after the other."""
    stop = np.cumsum(count)
    return np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - (stop - count), count)


def find_tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, kind) of the tokens of lower-cased bytes; a word that holds what is not ASCII or U+00C0 to U+00FF is one of kind _OTHER."""
    kind = _KIND[data]
    high = np.flatnonzero(data >= 0x80)
    if len(high):
        before, after = data[np.maximum(high - 1, 0)], data[np.minimum(high + 1, len(data) - 1)]
        lead, tail = data[high] == 0xC3, (data[high] < 0xC0) & (before == 0xC3) & (high > 0)
        kind[high[~tail & ~(lead & (after >= 0x80) & (after < 0xC0))]] = _OTHER
        sign = high[tail & ((data[high] == _SIGNS[0]) | (data[high] == _SIGNS[1]))]
        kind[sign], kind[sign - 1] = _MARK, _MARK
    if (kind == _OTHER).any():
        full = np.concatenate(([False], kind != _BLANK, [False]))
        first, stop = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(~full[1:] & full[:-1])
        odd = np.concatenate(([0], np.cumsum(kind == _OTHER)))
        chosen = odd[stop] > odd[first]
        kind[_spread(first[chosen], stop[chosen] - first[chosen])] = _OTHER
    change = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT), [True]))
    start = np.flatnonzero((kind != _BLANK) & change[:-1])
    stop = np.flatnonzero((kind != _BLANK) & change[1:]) + 1
    # An apostrophe that begins a token takes these letters along.
    lone = np.flatnonzero((data[start] == 0x27) & (stop - start == 1) & (stop < len(data)))
    lone = lone[kind[stop[lone]] == _LETTER]
    if len(lone):
        one, two = data[stop[lone]], data[np.minimum(stop[lone] + 1, len(data) - 1)]
        two = np.where(stop[lone] + 1 < stop[lone + 1], two, 0)
        pairs = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        take = np.where(np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)), 1, np.where(pairs, 2, 0))
        stop[lone] += take
        start[lone + 1] += take
        left = stop > start
        start, stop = start[left], stop[left]
    return start, stop - start, kind[start]


class Merges:
    """The merges of a tokenizer of the form _BY_WORDS, by bytes: the first merge that the file lists comes first."""

    def __init__(self, form: dict):
        model = form["model"]
        ids, pairs, made = model["vocab"], {}, []
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            pairs.setdefault(ids[left] << 32 | ids[right], len(made))
            made.append(ids[left + right])
        self.table, self.made = PairTable(pairs), np.array(made, dtype=np.int32)
        # Bytes that print are written as themselves, the others, in order, as the letters from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        #: Ids of bytes inside a token, and, behind them, of those that end one.
        self.bytes_ = np.array([ids[chr(others.get(b, b)) + end] for end in ("", model["end_of_word_suffix"]) for b in range(256)], dtype=np.int32)

    def _candidates(self, rows: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank = self.table.find(left, right)
        return np.where(rank < 0, NONE, rank), self.made[rank]

    def ids(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens at these places, one after the other, and how many each has."""
        counts, runs, order, low = np.zeros(len(size), dtype=np.int64), [], [], 0
        for high in (*(w for w in WIDTHS if w < size.max(initial=0)), int(size.max(initial=0))):
            chosen = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in np.split(chosen, range(1 << 14, len(chosen), 1 << 14)):
                inside = np.arange(high) < size[part][:, None]
                places = data[_spread(start[part], size[part])].astype(np.int64)
                places[np.cumsum(size[part]) - 1] += 256
                symbol = np.zeros((len(part), high), dtype=np.int32)
                symbol[inside] = self.bytes_[places]
                found, counts[part] = in_step(symbol, size[part], self._candidates) if len(part) else (symbol.reshape(-1), 0)
                runs.append(found)
                order.append(part)
        order, found = np.concatenate(order), np.concatenate(runs)
        first = np.empty(len(size), dtype=np.int64)
        first[order] = np.cumsum(counts[order]) - counts[order]
        return found[_spread(first, counts)], counts


class TokenTable:
    """Ids of tokens of at most 8 * LANES bytes, by their bytes: an open hash table that is asked for many at once."""

    def __init__(self, bits: int = SLOTS_BITS):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        #: What a slot holds: the token's bytes, and the place and number of its ids. No token has a zero byte, so empty slots are zero.
        self.lanes = np.zeros((size, LANES), dtype=np.uint64)
        self.first, self.count = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32)
        self.ids, self.used, self.held = np.zeros(1 << self.bits, dtype=np.int32), 0, 0

    def _slots(self, mixed: np.ndarray) -> np.ndarray:
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, lanes: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The slot of each token, or -1."""
        slot = self._slots(mixed)
        there = self.lanes[slot]
        out = np.where((there == lanes).all(axis=1), slot, -1)
        odd = np.flatnonzero((out < 0) & (there[:, 0] != 0))
        while len(odd):
            slot[odd] = (slot[odd] + 1) & ((1 << self.bits) - 1)
            there = self.lanes[slot[odd]]
            hit = (there == lanes[odd]).all(axis=1)
            out[odd[hit]] = slot[odd[hit]]
            odd = odd[~hit & (there[:, 0] != 0)]
        return out

    def put(self, lanes: np.ndarray, mixed: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Take distinct tokens that are not in the table."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        first = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.held += len(counts)
        slot, todo = self._slots(mixed), np.arange(len(counts))
        while len(todo):  # the first of those that ask for a free slot gets it
            free = todo[self.lanes[slot[todo], 0] == 0]
            _, chosen = np.unique(slot[free], return_index=True)
            won = free[chosen]
            self.lanes[slot[won]], self.first[slot[won]], self.count[slot[won]] = lanes[won], first[won], counts[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Ids of a tokenizer file as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        form = json.loads(self.tokenizer.to_str())
        marked = any(any(c.isspace() for c in t["content"]) or "<|" not in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in form["added_tokens"])
        self.by_words = (form["normalizer"], form["pre_tokenizer"]) == _BY_WORDS and not marked and not form["truncation"] and not form["padding"]
        plain = form["model"]["type"] == "BPE" and form["model"].get("end_of_word_suffix") and not any(
            form["model"].get(k) for k in ("dropout", "continuing_subword_prefix", "unk_token", "fuse_unk", "byte_fallback", "ignore_merges")
        )
        self.by_words = self.by_words and bool(plain)
        if self.by_words:
            self.merges, self.table = Merges(form), TokenTable()
            self.others = WordCache(self._whole, OTHERS)

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        """The library's ids."""
        found = self.tokenizer.encode_batch([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in found]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; long ones are worked off in stretches that end at white space."""
        if not self.by_words:
            return self._whole(texts)
        out: list[bytes] = [b""] * len(texts)
        # The tokenizer's special tokens are told by case, and may stand inside a word.
        special = [k for k, t in enumerate(texts) if b"<|" in t]
        for k, data in zip(special, self._whole([texts[k] for k in special]) if special else (), strict=True):
            out[k] = data
        some, size = [], 0
        for k, text in enumerate(texts):
            if b"<|" in text:
                continue
            if len(text) > STRETCH:
                out[k] = b"".join(d for part in _stretches(text) for d in self._together([part]))
                continue
            if size + len(text) > STRETCH:
                self._fill(out, some, texts)
                some, size = [], 0
            some.append(k)
            size += len(text)
        self._fill(out, some, texts)
        return out

    def _fill(self, out: list[bytes], some: list[int], texts: list[bytes]) -> None:
        for k, data in zip(some, self._together([texts[k] for k in some]), strict=True):
            out[k] = data

    def _together(self, texts: list[bytes]) -> list[bytes]:
        """Ids of some texts, found at once."""
        joined = b"\n".join(texts) + b"\n" + bytes(8 * LANES)
        whole = np.frombuffer(joined.lower(), dtype=np.uint8).copy()
        data = whole[: -8 * LANES]
        capital = np.flatnonzero((data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != _SIGNS[0]) & (data[:-1] == 0xC3)) + 1
        data[capital] += 0x20
        start, size, kind = find_tokens(data)
        # Places and numbers of the ids, first those of tokens that the table can hold.
        first, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        short = (size <= 8 * LANES) & (kind != _OTHER)
        ids = self._looked_up(whole, start[short], size[short])
        first[short], count[short] = ids[1:]
        runs, used = [ids[0]], len(ids[0])
        rest = np.flatnonzero(~short)
        if len(rest):
            words = [joined[a:b] for a, b in zip(start[rest].tolist(), (start + size)[rest].tolist(), strict=True)]
            each = self.others.each(words)
            count[rest] = np.fromiter(map(len, each), dtype=np.int64, count=len(rest)) // 4
            first[rest] = used + np.cumsum(count[rest]) - count[rest]
            runs.append(np.frombuffer(b"".join(each), dtype="<u4").astype(np.int32))
        found = (np.concatenate(runs) if len(runs) > 1 else runs[0])[_spread(first, count)].astype("<u4").tobytes()
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        before = np.concatenate(([0], np.cumsum(count)))
        cuts = (4 * before[np.searchsorted(start, ends)]).tolist()
        return [found[a:b] for a, b in pairwise([0, *cuts])]

    def _looked_up(self, whole: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): where the ids of each short token are."""
        table = self.table
        if table.held > MOST:
            table.clear()
        eights = np.ndarray(shape=(len(whole) - 7,), dtype="<u8", buffer=whole, strides=(1,))
        lanes = np.empty((len(start), LANES), dtype=np.uint64)
        mixed = np.zeros(len(start), dtype=np.uint64)
        for k in range(LANES):
            lanes[:, k] = eights[start + 8 * k] & _CUT[np.clip(size - 8 * k, 0, 8)]
            mixed = (mixed ^ lanes[:, k]) * _HASH[k]
            mixed ^= mixed >> np.uint64(29)
        mixed *= _HASH[0]
        slot = table.find(lanes, mixed)
        gaps = np.flatnonzero(slot < 0)
        if len(gaps):
            # Equal tokens are next to one another by their hash, or, where two hashes are equal, are put once more by bytes.
            _, one = np.unique(mixed[gaps], return_index=True)
            while len(one):
                new = gaps[one]
                if table.held + len(new) > (1 << table.bits) * 7 // 10:  # only texts of very many new tokens get here
                    self.table = table = TokenTable(table.bits + 1)
                    return self._looked_up(whole, start, size)
                table.put(lanes[new], mixed[new], *self.merges.ids(whole, start[new], size[new]))
                slot[gaps] = table.find(lanes[gaps], mixed[gaps])
                gaps = gaps[slot[gaps] < 0]
                _, one = np.unique(mixed[gaps], return_index=True)
        return table.ids, table.first[slot].astype(np.int64), table.count[slot].astype(np.int64)


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text cut at white space, into parts of STRETCH bytes and the word that ends there."""
    at = 0
    while at < len(text):
        blank = _WHITE.search(text, at + STRETCH)
        cut = blank.start() if blank else len(text)
        yield text[at:cut]
        at = cut


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for a worker, with what it knows of words from earlier tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
