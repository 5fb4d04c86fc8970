"""Piece vocabularies (SentencePiece model files), and texts as units that no piece crosses."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

_NORMAL, _BYTE = 1, 6
SPACE = "▁"
_UNIT = re.compile(r" +[^ \n]*|[^ \n]+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces written as spaces. ``scores`` are as in the file, by id; ``bytes_`` are the ids of bytes 0 to 255."""

    pieces: dict[str, int]
    scores: list[float]
    bytes_: list[int]
    prefix: bool


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file with byte fallback, no normal form, and pieces that hold a space at their start only."""
    proto = read_model(path)
    if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.trainer_spec.byte_fallback:
        raise ValueError(f"{path}: a vocabulary without normal form, with all blanks and with byte fallback is asked for")
    pieces = {p.piece.replace(SPACE, " "): i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
    if any(" " in p.lstrip(" ") or "\n" in p for p in pieces):
        raise ValueError(f"{path}: a piece crosses a word or a line")
    byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
    return Vocabulary(pieces, [p.score for p in proto.pieces], [byte[f"<0x{b:02X}>"] for b in range(256)], proto.normalizer_spec.add_dummy_prefix)


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


def unigram_scores(scores: list[float]) -> list[int]:
    """Scores of a merge vocabulary (minus the rank) as unigram scores, in 64ths: a piece of rank r is about as frequent as 1 / r.

    Multiples of 1/64 add up exactly, so ties are ties.
    """
    return [-round(64 * math.log(2 - s)) for s in scores]


def units(text: str, prefix: bool) -> list[str]:
    """The text, after a space if ``prefix`` and it is not empty, in parts that no piece crosses: lines, and words with the spaces before them."""
    if not text:
        return []
    text = f" {text}" if prefix else text
    if "  " in text or "\0" in text:
        return _UNIT.findall(text)
    return [u for u in text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0") if u]
