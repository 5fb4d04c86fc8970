"""Quality rules by repetition coverage.

Word n-grams of a document get rolling hashes in numpy; every occurrence of an n-gram that
comes twice or more in the document is covered, and the share of the document's code points
in covered words is measured for several n, as is the share in lines that repeat an earlier
line. Only positions whose three-word window repeats can start a longer repeated n-gram, so
one sort over all words serves every length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.rows import free_name
from leafsieve.llm.textwork import BLANK, slices, tidy
from leafsieve.runtime import ship

#: Share of code points in repeated n-grams beyond which a document goes, by n.
MOST_COVERED = {5: 0.50, 7: 0.45, 10: 0.40}
#: Share of code points in lines equal to an earlier line beyond which a document goes.
MOST_DUP_LINES = 0.30
#: Share of symbols among the code points of words beyond which a document goes.
MOST_SYMBOLS = 0.10
#: Base rules: fewest words, and the percentage of words in repeated three-word windows.
LEAST_WORDS, MOST_REPEAT = 50, 50

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_STRIP = " \t\n\v\f\r"

FIELDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
    "base_failed": pa.bool_(), "kept": pa.bool_(), "dup_line_share": pa.float64(),
    **{f"covered_{n}": pa.float64() for n in MOST_COVERED},
}
_DDL = {pa.int64(): "long", pa.bool_(): "boolean", pa.float64(): "double"}
SCHEMA = "struct<" + ", ".join(f"{k}: {_DDL[t]}" for k, t in FIELDS.items()) + ">"


def _window_ids(words: np.ndarray, n: int) -> np.ndarray:
    """Exact ids of the windows of n words at each place; equal ids mean equal windows."""
    ids = words.astype(np.int64)
    for k in range(1, n):
        left, right = ids[: len(words) - k], words[k:]
        if int(ids.max(initial=0) + 1) * int(words.max(initial=0) + 1) >= 1 << 62:
            left = np.unique(left, return_inverse=True)[1]
        ids = left * (int(words.max(initial=0)) + 1) + right
    return ids


def _repeated(ids: np.ndarray, doc: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Those of ``places`` (ascending) whose id comes twice or more in the same document."""
    order = np.argsort(ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (doc[places[order[1:]]] == doc[places[order[:-1]]])
    hit = np.zeros(len(places), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return places[hit]


def _covered(places: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of n words that starts at one of ``places``."""
    edge = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _lines(data: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the code points in them."""
    if b"\n" not in data:
        return 0, 0
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\v\f\r")]
    if len(lines) == len(set(lines)):
        return 0, 0
    seen, count, points = set(), 0, 0
    for line in lines:
        if line in seen:
            count += 1
            points += len(line.decode("utf-8", "surrogatepass"))
        seen.add(line)
    return count, points


def measure(texts: list[bytes]) -> pd.DataFrame:
    """The measures of some texts, a row each, as in ``FIELDS``."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    blank = BLANK[data]
    first = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    point = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(point & ~blank)))
    every = np.concatenate(([0], np.cumsum(point)))
    last = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])))
    word_points = points[last + 1] - points[first]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    doc = np.searchsorted(starts, first, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    word_chars = points[starts + sizes] - points[starts]
    total = len(first)
    spans = np.empty(2 * total, dtype=np.int32 if data.size < 1 << 31 else np.int64)
    spans[0::2], spans[1::2] = first, last + 1
    # Words and the blanks between them as one string array; the words are every second entry.
    offsets = np.append(spans, np.asarray([spans[-1]] if total else [0], dtype=spans.dtype))
    kind = pa.StringArray if spans.dtype == np.int32 else pa.LargeStringArray
    pieces = kind.from_buffers(2 * total, pa.py_buffer(offsets), pa.py_buffer(data))
    ids = pc.dictionary_encode(pieces.take(pa.array(np.arange(0, 2 * total, 2)))).indices.to_numpy(zero_copy_only=False).astype(np.int64)

    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols[starts + sizes] - symbols[starts]}
    lines = [_lines(t) for t in texts]
    out["n_dup_lines"] = np.array([x[0] for x in lines], dtype=np.int64)
    whole = np.maximum(every[starts + sizes] - every[starts], 1)
    out["dup_line_share"] = np.array([x[1] for x in lines], dtype=np.int64) / whole

    def within(n: int) -> np.ndarray:
        return doc[: total - n + 1] == doc[n - 1 :] if total >= n else np.zeros(0, dtype=bool)

    places = np.flatnonzero(within(3))
    windows = _window_ids(ids, 3) if total >= 3 else np.zeros(0, dtype=np.int64)
    places = _repeated(windows[places], doc, places)
    cover = _covered(places, 3, total)
    out["n_repeat_words"] = np.bincount(doc[cover], minlength=len(texts)).astype(np.int64)

    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.uint64) + np.uint64(1)) * _P
        mixed ^= mixed >> np.uint64(29)
        for n in MOST_COVERED:
            ok = within(n)
            places = places[places < len(ok)]
            places = places[ok[places]]
            rolling = np.zeros(len(places), dtype=np.uint64)
            for k in range(n):
                rolling = rolling * _P + mixed[places + k]
            places = _repeated(rolling, doc, places)
            share = np.bincount(doc, weights=word_points * _covered(places, n, total), minlength=len(texts))
            out[f"covered_{n}"] = share / np.maximum(word_chars, 1)
    failed = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT * n_words)
    bad = (out["dup_line_share"] > MOST_DUP_LINES) | (out["n_symbols"] > MOST_SYMBOLS * word_chars)
    for n, most in MOST_COVERED.items():
        bad |= out[f"covered_{n}"] > most
    out["base_failed"], out["kept"] = failed, ~failed & ~bad
    return pd.DataFrame(out)[list(FIELDS)]


def _measure_batch(texts: pa.Array) -> pa.Array:
    parts = [measure(held) for _, held in slices(texts.to_pylist())]
    tidy()
    frame = pd.concat(parts) if parts else pd.DataFrame({k: [] for k in FIELDS})
    return pa.StructArray.from_arrays([pa.array(frame[k], type=t) for k, t in FIELDS.items()], names=list(FIELDS))


def annotate_quality(docs: DataFrame, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with a struct of measures and the verdict ``kept``.

    A null or empty text has no words, so it fails. Other columns stay as they are; one
    named ``out_col`` is replaced. Repeated rows are judged alike, an empty table stays empty.
    """
    ship(docs.sparkSession)
    judge = F.arrow_udf(_measure_batch, SCHEMA)
    return docs.withColumn(out_col, judge(F.col(text_col)))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    verdict = free_name(docs, "quality")
    return annotate_quality(docs, text_col, verdict).where(F.col(verdict)["kept"]).drop(verdict)
