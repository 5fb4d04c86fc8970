"""Chat formatting with typed content parts.

A turn's content is a list of parts (text, image, audio, document). A visitor flattens the
turns of a conversation in order: texts are escaped, every other part becomes a placeholder with
its number in the conversation, and its reference and the tokens that it stands for are
recorded under that number. Control strings inside texts are broken by a backslash, also those that are cut over
texts with nothing between, so a
text can neither end a turn nor forge one or a placeholder, and the output reads back to
the same turns and parts.
"""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.runtime import ship

#: Marks of the template: a turn is OPEN role ROLE content CLOSE, and the assistant's, which
#: alone lie under the loss mask, LEARN role ROLE content STOP.
OPEN, CLOSE, LEARN, STOP, ROLE, PART, ENDPART = "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[PART]", "[/PART]"
CONTROLS = (OPEN, CLOSE, LEARN, STOP, ROLE, PART, ENDPART, "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(
    f"(?P<mark>{re.escape(OPEN)}|{re.escape(LEARN)})(?P<role>.*?){re.escape(ROLE)}(?P<content>.*?)(?:{re.escape(CLOSE)}|{re.escape(STOP)})", re.DOTALL
)
_PART = re.compile(f"{re.escape(PART)}(?P<kind>[a-z]+):(?P<number>[0-9]+){re.escape(ENDPART)}")
ASSISTANT = "assistant"

#: Tokens of a part: an image by tiles and one for its end, audio by seconds, a document by pages.
TILE, TILE_TOKENS, AUDIO_PER_SECOND, PAGE_TOKENS = 336, 144, 25, 512


def escape(text: str) -> str:
    """Double every backslash and break every control string after its first character."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class PartError(ValueError):
    """A content part that is not as it should be; it is left out and reported."""


def _measure(part: dict, name: str, otherwise: float) -> float:
    """A positive number of ``part``; one that is missing or null is ``otherwise``."""
    value = part.get(name)
    if value is None:
        return otherwise
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value) or value <= 0:
        raise PartError(f"{name} is no positive number")
    return value


class Flatten:
    """Visits the parts of a conversation's turns in order; collects the output, the loss spans, the attachments and what is wrong."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.at = 0
        self.spans: list[tuple[int, int]] = []
        self.attachments: list[tuple[str, str, int]] = []
        self.errors: list[tuple[int, int, str]] = []
        self.texts: list[str] = []  # of neighbouring parts, which are escaped as one

    def write(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def flush(self) -> None:
        if self.texts:
            self.write(escape("".join(self.texts)))
            self.texts = []

    def turn(self, number: int, role: str | None, parts: list) -> None:
        """A turn in the template; a null role counts as an empty one. ``number`` is its place in the conversation."""
        learned = role == ASSISTANT
        self.write(f"{LEARN if learned else OPEN}{escape(role or '')}{ROLE}")
        begin = self.at
        for k, part in enumerate(parts):
            try:
                self.visit(part)
            except PartError as wrong:
                self.errors.append((number, k, str(wrong)))
        self.flush()
        if learned:
            self.spans.append((begin, self.at))
        self.write(STOP if learned else CLOSE)

    def visit(self, part: dict) -> None:
        if not isinstance(part, dict):
            raise PartError("the part is no object")
        kind = part.get("type")
        if kind not in ("text", "image", "audio", "document"):
            raise PartError("no such type")
        getattr(self, f"visit_{kind}")(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text")
        if text is not None and not isinstance(text, str):
            raise PartError("text is no string")
        self.texts.append(text or "")

    def visit_image(self, part: dict) -> None:
        tiles = math.ceil(_measure(part, "width", TILE) / TILE) * math.ceil(_measure(part, "height", TILE) / TILE)
        self.placeholder("image", part, tiles * TILE_TOKENS + 1)

    def visit_audio(self, part: dict) -> None:
        self.placeholder("audio", part, math.ceil(_measure(part, "seconds", 0) * AUDIO_PER_SECOND))

    def visit_document(self, part: dict) -> None:
        self.placeholder("document", part, math.ceil(_measure(part, "pages", 1)) * PAGE_TOKENS)

    def placeholder(self, kind: str, part: dict, tokens: int) -> None:
        ref = part.get("ref")
        if ref is not None and not isinstance(ref, str):
            raise PartError("ref is no string")
        if tokens >> 62:
            raise PartError("too large")
        self.flush()
        self.write(f"{PART}{kind}:{len(self.attachments)}{ENDPART}")
        self.attachments.append((kind, ref or "", tokens))


def parts_of(content: str | None, typed: bool) -> list:
    """The parts of a content: one text, or with ``typed`` those of a JSON list. What is no such list is one part that is reported."""
    if not content:
        return []
    if not typed:
        return [{"type": "text", "text": content}]
    try:
        parts = json.loads(content)
    except (ValueError, RecursionError):
        return [None]
    return parts if isinstance(parts, list) else [None]


def format_turns(turns: list[tuple[str | None, list]]) -> Flatten:
    """A conversation of (role, parts), visited."""
    visitor = Flatten()
    for number, (role, parts) in enumerate(turns):
        visitor.turn(number, role, parts)
    return visitor


def read_back(formatted: str) -> list[tuple[str, str, bool, int, int]]:
    """(role, text, learned, start, stop) of each turn; start to stop is the content in the output, still escaped.

    Placeholders stand in the text as they are in the output.
    """
    return [
        (unescape(m["role"]), unescape(m["content"]), m["mark"] == LEARN, m.start("content"), m.end("content"))
        for m in _TURN.finditer(formatted)
    ]


def read_parts(content: str) -> list[tuple[str, str] | tuple[str, int]]:
    """The parts of a turn's content as it stands in the output: ("text", text) and (kind, number of the attachment), in order."""
    out, at = [], 0
    for m in _PART.finditer(content):
        out += [("text", unescape(content[at : m.start()]))] if m.start() > at else []
        out.append((m["kind"], int(m["number"])))
        at = m.end()
    return out + ([("text", unescape(content[at:]))] if at < len(content) else [])


_CHAT = pa.struct([
    ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))), ("attachment_tokens", pa.int64()),
    ("errors", pa.list_(pa.struct([("turn", pa.int64()), ("part", pa.int64()), ("reason", pa.string())]))),
])
_CHAT_DDL = (
    "struct<formatted: string, loss_spans: array<struct<start: bigint, stop: bigint>>, attachments: array<struct<kind: string, ref: string, tokens: bigint>>,"
    " attachment_tokens: bigint, errors: array<struct<turn: bigint, part: bigint, reason: string>>>"
)


def _format(typed: bool):
    def run(conversations: pa.Array) -> pa.Array:
        out = []
        for turns in conversations:
            seen = format_turns([(t["role"], parts_of(t["content"], typed)) for t in turns.as_py()])
            out.append({
                "formatted": "".join(seen.out), "loss_spans": [{"start": a, "stop": b} for a, b in seen.spans],
                "attachments": [{"kind": k, "ref": r, "tokens": n} for k, r, n in seen.attachments], "attachment_tokens": sum(n for _, _, n in seen.attachments),
                "errors": [{"turn": t, "part": k, "reason": r} for t, k, r in seen.errors],
            })
        return pa.array(out, type=_CHAT)

    return run


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", typed: bool = False,
) -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans, attachments, attachment_tokens, errors.

    The content is plain text, or with ``typed`` a JSON list of parts such as ``{"type": "text",
    "text": …}`` or ``{"type": "image", "ref": …, "width": …, "height": …}``. Null or empty
    content is an empty turn. Turns come by their number; of equal numbers (null first) the
    smaller role, then the smaller content comes first, and repeated rows each make a turn.
    ``loss_spans`` are the assistant's contents in ``formatted``, in code points. A placeholder's number is its
    place in ``attachments``, which are the conversation's. A part of an unknown type, or with a value that is no string or no
    positive number where one belongs, is left out, and so is content that is no JSON list; each is a row of ``errors`` (turn and
    part by their place), and the rest of the conversation stands. Rows without conv_id are one conversation, without id. An
    empty table gives no row; further columns are ignored.
    """
    ship(turns.sparkSession)
    order = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(content_col), F.lit("")).alias("content"))
    listed = turns.select(F.col(conv_col).alias("conv_id"), order.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))
    made = F.arrow_udf(_format(typed), _CHAT_DDL)
    return listed.select("conv_id", made("turns").alias("made")).select("conv_id", "made.*")


_DIGEST_TYPE = pa.struct([
    ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])
_DIGEST_DDL = "struct<n_turns: bigint, turns_sha256: string, loss_chars: bigint, loss_sha256: string, formatted_chars: bigint>"


def _digest(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, masked in zip(formatted.to_pylist(), spans.to_pylist(), strict=True):
        turns = read_back(text)
        learned = "".join(unescape(text[s["start"] : s["stop"]]) for s in masked)
        whole = "".join(f"{role}\n{said}\n" for role, said, *_ in turns)
        out.append({
            "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(learned),
            "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(), "formatted_chars": len(text),
        })
    return pa.array(out, type=_DIGEST_TYPE)


def digest_chats(chats: DataFrame) -> DataFrame:
    """What the formatted output of :func:`format_chats` reads back to, as counts and digests, a row per conversation; an empty table gives none."""
    read = F.arrow_udf(_digest, _DIGEST_DDL)
    return chats.withColumn("read", read(F.col("formatted"), F.col("loss_spans"))).select("conv_id", "read.*")
