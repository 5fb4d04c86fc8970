"""Encoding by merges with seeded dropout, and decoding.

A unit starts as letters; candidate merges wait in an agenda by rank, the leftmost of equals
first. Each candidate is skipped when a keyed hash of the seed, the id of the text, the place of
the unit in the text, the place in the unit and the piece falls below the dropout, so one seed
always gives one segmentation, another seed another, and any of them decodes to the same text.
What a unit becomes depends on which of its candidates are skipped and on nothing else: all
candidates of a unit are drawn at once, and units whose skipped candidates were met before are
remembered. The agendas of the others are worked off in step with array operations.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.agendas import NONE, WIDTHS, PairTable, in_step
from leafsieve.llm.textwork import CACHE_WORDS, WordCache, tidy
from leafsieve.llm.vocabulary import Vocabulary, load_vocabulary, units
from leafsieve.runtime import ship

DROPOUT = 0.1
#: Units whose candidates are remembered, and outcomes of a unit and its skipped candidates in a generation.
KNOWN_UNITS, KNOWN_OUTCOMES = 150_000, 250_000
#: Units that are drawn at once, how often a unit is among them to be remembered, and the most candidates it may have for that (bits of a mask).
DRAWN, OFTEN, MASK = 1 << 17, 12, 64
#: Units with more letters than this get an agenda of their own.
IN_STEP = WIDTHS[-1]
_K1, _K2, _K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Merges:
    """The vocabulary as merges: symbols are piece ids, or ``base`` plus the code point of a letter that is no piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.pieces, self.bytes_ = vocabulary.pieces, vocabulary.bytes_
        self.base = len(vocabulary.scores)
        order = sorted({vocabulary.scores[i] for i in self.pieces.values()}, reverse=True)
        ranks = {s: k for k, s in enumerate(order)}
        self.rank = np.array([ranks.get(s, 0) for s in vocabulary.scores], dtype=np.int32)
        top = max((ord(c) for p in self.pieces for c in p), default=0)
        self.letters = np.arange(self.base, self.base + top + 2, dtype=np.int64)
        for piece, i in self.pieces.items():
            if len(piece) == 1:
                self.letters[ord(piece)] = i
        pairs = {}
        for piece, i in self.pieces.items():
            for k in range(1, len(piece)):
                left, right = self.symbol(piece[:k]), self.symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self.pairs = pairs
        self.table = PairTable(pairs)

    def symbol(self, text: str) -> int | None:
        if len(text) == 1:
            return int(self.letters[ord(text)])
        return self.pieces.get(text)

    def symbols(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        return np.where(points < len(self.letters), self.letters[np.minimum(points, len(self.letters) - 1)], self.base + points)

    def ids(self, symbols: np.ndarray) -> bytes:
        """Ids of final symbols; a letter that is no piece goes as its bytes."""
        if (symbols < self.base).all():
            return symbols.astype("<u4").tobytes()
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s < self.base else [self.bytes_[b] for b in chr(s - self.base).encode("utf-8", "surrogatepass")]
        return np.array(out, dtype="<u4").tobytes()


def _dropped(key: np.ndarray, start: np.ndarray, piece: np.ndarray, limit: int) -> np.ndarray:
    """Whether the candidate that makes ``piece`` from place ``start`` of the unit with hash ``key`` is skipped."""
    if not limit:
        return np.zeros(len(key), dtype=bool)
    with np.errstate(over="ignore"):
        h = key ^ (start.astype(np.uint64) * _K2) ^ (piece.astype(np.uint64) * _K3)
        h ^= h >> np.uint64(33)
        h *= _K1
        h ^= h >> np.uint64(29)
        h *= _K2
        h ^= h >> np.uint64(32)
    return h < np.uint64(limit)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64 bits of each number."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class DropoutEncoder:
    """Encodes texts with one seed and dropout; each unit of each text is drawn anew, or, if ``variants`` is given, texts share that many draws of a word."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = 0, variants: int | None = None):
        self.merges, self.prefix = Merges(vocabulary), vocabulary.prefix
        self.limit, self.seed, self.variants = int(dropout * 2**64) if dropout < 1 else 2**64 - 1, seed, variants and max(variants, 1)
        self.caches = [WordCache(lambda words, v=v: self.encode_units(words, v), limit=CACHE_WORDS // self.variants) for v in range(self.variants or 0)]
        self._forget()
        strings = {i: p.encode() for p, i in vocabulary.pieces.items()} | {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_)}
        self.strings = [strings.get(i, b"") for i in range(len(vocabulary.scores))]

    def variant(self, doc_id: int | None) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.seed}:{doc_id}") % self.variants

    def keys(self, words: list[str], variant: int) -> np.ndarray:
        mixed = xxhash.xxh3_64_intdigest(f"{self.seed}/{variant}")
        return np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"), mixed) for w in words], dtype=np.uint64)

    def encode_units(self, words: list[str], variant: int) -> list[bytes]:
        return self.encode_keyed(words, self.keys(words, variant))

    def encode_keyed(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """Ids of each word, its candidates drawn by its key."""
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        low = 0
        for high in WIDTHS:
            chosen = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(chosen), 1 << 14):
                part = chosen[k : k + (1 << 14)]
                for i, ids in zip(part.tolist(), self._in_step([words[i] for i in part], keys[part], high), strict=True):
                    out[i] = ids
            low = high
        for i in np.flatnonzero(sizes > IN_STEP).tolist():
            out[i] = self.merges.ids(self.agenda(words[i], keys[i]))
        return out

    def _candidates(self, key, start, left, right):
        """(rank, piece) of candidate merges; skipped ones and ones that make no piece have the rank NONE."""
        piece = self.merges.table.find(left, right)
        rank = np.full(len(piece), NONE, dtype=np.int32)
        good = np.flatnonzero(piece >= 0)
        made = piece[good]
        stay = ~_dropped(key[good], start[good], made, self.limit)
        rank[good[stay]] = self.merges.rank[made[stay]]
        return rank, piece

    def _in_step(self, words: list[str], keys: np.ndarray, width: int) -> list[bytes]:
        """Ids of words of at most ``width`` letters."""
        sizes = np.array([len(w) for w in words])
        symbol = np.zeros((len(words), width), dtype=np.int32)
        symbol[np.arange(width) < sizes[:, None]] = self.merges.symbols("".join(words))
        final, ends = in_step(symbol, sizes, lambda rows, start, left, right: self._candidates(keys[rows], start, left, right))
        stops = np.cumsum(ends)
        odd = set(np.searchsorted(stops, np.flatnonzero(final >= self.merges.base), side="right").tolist())
        data = final.astype("<u4").tobytes()
        return [
            self.merges.ids(final[stop - n : stop]) if k in odd else data[4 * (stop - n) : 4 * stop]
            for k, (n, stop) in enumerate(zip(ends.tolist(), stops.tolist(), strict=True))
        ]

    def agenda(self, word: str, key: np.uint64, met: dict | None = None) -> np.ndarray:
        """The symbols of one unit, by an agenda of its own; as those of the units in step. With ``met`` nothing is skipped, and candidates go into it."""
        symbol = self.merges.symbols(word).tolist()
        after, before = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1))
        alive, heap = [True] * len(symbol), []
        keyed = np.array([key], dtype=np.uint64)

        def propose(i: int) -> None:
            j = after[i] if i >= 0 else len(symbol)
            made = self.merges.pairs.get(symbol[i] << 32 | symbol[j]) if 0 <= i and j < len(symbol) else None
            if made is not None and met is not None:
                met[i, made] = None
            if made is not None and (met is not None or not _dropped(keyed, np.array([i]), np.array([made]), self.limit)[0]):
                heapq.heappush(heap, (int(self.merges.rank[made]), i, symbol[i], symbol[j], made))

        for i in range(len(symbol)):
            propose(i)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or symbol[i] != left or j >= len(symbol) or symbol[j] != right:
                continue
            symbol[i], alive[j], after[i] = made, False, after[j]
            if after[i] < len(symbol):
                before[after[i]] = i
            propose(before[i])
            propose(i)
        return np.array([s for s, ok in zip(symbol, alive, strict=True) if ok], dtype=np.int64)

    def encode(self, texts: list[str | None], doc_ids: list[int | None]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each text; null as empty."""
        split = [units(t, self.prefix) if t else [] for t in texts]
        if self.variants is None:
            return self._drawn_texts(split, doc_ids)
        variants = [self.variant(i) for i in doc_ids]
        out: list[bytes] = [b""] * len(texts)
        for v in set(variants):
            mine = [k for k, x in enumerate(variants) if x == v]
            known = self.caches[v].values([split[k] for k in mine])
            for k in mine:
                out[k] = b"".join(map(known.__getitem__, split[k]))
        return out

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.plain: list[bytes] = [b""]  # units are counted from 1
        #: By unit: its first candidate in ``drawn``, their number, and the mask of those that are met if none is skipped.
        self.first, self.count = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.met, self.drawn, self.used = np.zeros(1024, dtype=np.uint64), np.zeros(1024, dtype=np.uint64), 0
        self.young: dict[tuple[int, int], bytes] = {}
        self.old: dict[tuple[int, int], bytes] = {}

    def _learn(self, words: list[str]) -> None:
        """Candidates of units that are new: every piece in a unit is one. Units with too many of them have the index -1."""
        pieces, longest = self.merges.pieces, max(map(len, self.merges.pieces), default=0)
        for word in words:
            n, met = len(word), {}
            self.index[word] = -1
            if n > IN_STEP:
                continue
            found = [(i, pieces[word[i:j]]) for i in range(n - 1) for j in range(i + 2, min(n, i + longest) + 1) if word[i:j] in pieces]
            if len(found) > MASK:
                continue
            symbols = self.agenda(word, np.uint64(0), met)
            order = [*met, *(c for c in found if c not in met)]
            k, size = len(self.plain), len(order)
            if k == len(self.first):
                self.first, self.count, self.met = (np.concatenate((x, np.zeros_like(x))) for x in (self.first, self.count, self.met))
            if self.used + size > len(self.drawn):
                self.drawn = np.concatenate((self.drawn, np.zeros_like(self.drawn)))
            self.first[k], self.count[k], self.met[k] = self.used, size, (1 << len(met)) - 1
            if size:
                pair = np.array(order, dtype=np.uint64)
                with np.errstate(over="ignore"):
                    self.drawn[self.used : self.used + size] = (pair[:, 0] * _K2) ^ (pair[:, 1] * _K3)
            self.used += size
            self.index[word] = k
            self.plain.append(self.merges.ids(symbols))

    def unit_keys(self, doc_id: int | None, n: int) -> np.ndarray:
        """The keys of the first ``n`` units of a text."""
        with np.errstate(over="ignore"):
            return _mixed(np.uint64(xxhash.xxh3_64_intdigest(f"{self.seed}:{doc_id}")) + np.arange(1, n + 1, dtype=np.uint64) * _K1)

    def _masks(self, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which candidates of each known unit are skipped; 0 too if none is that would be met without the others."""
        count = self.count[at]
        owner = np.repeat(np.arange(len(at)), count)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        none = np.zeros(len(owner), dtype=np.uint64)
        hit = np.flatnonzero(_dropped(keys[owner] ^ self.drawn[np.repeat(self.first[at], count) + inside], none, none, self.limit))
        out = np.zeros(len(at), dtype=np.uint64)
        if len(hit):
            who, bits = owner[hit], np.uint64(1) << inside[hit].astype(np.uint64)
            begin = np.flatnonzero(np.diff(who, prepend=-1))
            out[who[begin]] = np.bitwise_or.reduceat(bits, begin)
        return np.where(out & self.met[at], out, np.uint64(0))

    def _drawn(self, words: list[str], keys: np.ndarray) -> list[bytes]:
        """As encode_keyed, with what is known."""
        at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            often = Counter(map(words.__getitem__, unknown.tolist()))
            new = [w for w, n in often.items() if n >= OFTEN and w not in self.index]
            if new:
                if len(self.index) + len(new) > KNOWN_UNITS:
                    self._forget()
                    new = [w for w, n in Counter(words).items() if n >= OFTEN]
                self._learn(new)
                at = np.fromiter(map(self.index.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(self.young) > KNOWN_OUTCOMES:
            self.old, self.young = self.young, {}
        out = list(map(self.plain.__getitem__, np.maximum(at, 0).tolist()))
        known = np.flatnonzero(at >= 0)
        masks = self._masks(at[known], keys[known])
        skipped = np.flatnonzero(masks)
        places = known[skipped]
        young, old, missing, waiting = self.young, self.old, {}, []
        for i, name in zip(places.tolist(), zip(at[places].tolist(), masks[skipped].tolist(), strict=True), strict=True):
            ids = young.get(name)
            if ids is None:
                ids = old.get(name)
                if ids is None:
                    missing.setdefault(name, i)
                    waiting.append((i, name))
                    continue
                young[name] = ids
            out[i] = ids
        alone = np.flatnonzero(at < 0).tolist()
        todo = [*missing.values(), *alone]
        if todo:
            made = self.encode_keyed([words[i] for i in todo], keys[todo])
            young.update(zip(missing, made, strict=False))
            for i, name in waiting:
                out[i] = young[name]
            for i, ids in zip(alone, made[len(missing) :], strict=True):
                out[i] = ids
        return out

    def _drawn_texts(self, split: list[list[str]], doc_ids: list[int | None]) -> list[bytes]:
        words = [w for s in split for w in s]
        keys = np.concatenate([self.unit_keys(d, len(s)) for d, s in zip(doc_ids, split, strict=True)]) if split else np.zeros(0, dtype=np.uint64)
        ids: list[bytes] = []
        for k in range(0, len(words), DRAWN):
            ids += self._drawn(words[k : k + DRAWN], keys[k : k + DRAWN])
        stops = np.cumsum([len(s) for s in split]).tolist()
        return [b"".join(ids[stop - len(s) : stop]) for s, stop in zip(split, stops, strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The text, in UTF-8, that the ids stand for."""
        joined = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return joined[1:] if self.prefix else joined


_encoders: dict[tuple, DropoutEncoder] = {}


def encoder(path: str, dropout: float, seed: int, variants: int | None) -> DropoutEncoder:
    """One encoder for a worker, with what it knows of words from earlier tasks."""
    key = path, dropout, seed, variants
    if key not in _encoders:
        _encoders[key] = DropoutEncoder(load_vocabulary(path), dropout, seed, variants)
    return _encoders[key]


def encode_pieces(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", out_col: str = "ids",
    dropout: float = DROPOUT, seed: int = 0, variants: int | None = None,
) -> DataFrame:
    """``docs`` with the ids (little-endian, 32 bits, binary) of a segmentation under ``seed``.

    Any segmentation decodes to the text, byte for byte. A literal U+2581 goes as bytes, so that it does not come
    back as a space. A null or empty text has no ids; a null id is a key like any other; rows with equal ids and
    texts get equal ids. With ``variants``, texts share that many segmentations of a word. Other columns stay; one named ``out_col`` is replaced. With a dropout of 0 this is the tokenizer's own segmentation.
    """

    def run(doc_ids: pa.Array, texts: pa.Array) -> pa.Array:
        names, held, out = doc_ids.to_pylist(), texts.to_pylist(), []
        for k in range(0, len(held), 256):
            out += encoder(model_path, dropout, seed, variants).encode(held[k : k + 256], names[k : k + 256])
        tidy()
        return pa.array(out, pa.binary())

    ship(docs.sparkSession)
    return docs.withColumn(out_col, F.arrow_udf(run, "binary")(F.col(id_col), F.col(text_col)))


def decode_pieces(encoded: DataFrame, model_path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its ids; null ids give a null text."""

    def run(ids: pa.Array) -> pa.Array:
        decode = encoder(model_path, 0.0, 0, 1).decode
        return pa.array([None if x is None else decode(x).decode("utf-8") for x in ids.to_pylist()], pa.string())

    ship(encoded.sparkSession)
    return encoded.withColumn(out_col, F.arrow_udf(run, "string")(F.col(ids_col)))


_CHECKED = pa.struct([("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("lossless", pa.bool_()), ("ids", pa.binary())])
_CHECKED_DDL = "struct<n_ids: bigint, ids_crc32: bigint, decoded_sha256: string, lossless: boolean, ids: binary>"


def encode_checked(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = DROPOUT, seed: int = 0, variants: int | None = None) -> DataFrame:
    """doc_id, and of the ids of its text: n_ids, ids_crc32, decoded_sha256 (of what they decode to), lossless (whether that is the text), ids.

    The ids are those of :func:`encode_pieces`, and they are decoded where they are made. A null or empty text has
    no ids and decodes to the empty text; every row gives a row, an empty table none; other columns are not read.
    """

    def run(doc_ids: pa.Array, texts: pa.Array) -> pa.Array:
        code, names, held, out = encoder(model_path, dropout, seed, variants), doc_ids.to_pylist(), texts.to_pylist(), []
        for k in range(0, len(held), 256):
            for text, ids in zip(held[k : k + 256], code.encode(held[k : k + 256], names[k : k + 256]), strict=True):
                back = code.decode(ids)
                out.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back).hexdigest(), back == (text or "").encode("utf-8", "surrogatepass"), ids))
        tidy()
        cols = list(zip(*out, strict=True)) or [[]] * len(_CHECKED)
        return pa.StructArray.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _CHECKED, strict=True)], fields=list(_CHECKED))

    ship(docs.sparkSession)
    made = F.arrow_udf(run, _CHECKED_DDL)(F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")
