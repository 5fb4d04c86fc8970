"""Keeping the metadata document of a book in step with its pages, by splices into its text."""

from __future__ import annotations

import re
from collections.abc import Iterable
from xml.parsers import expat

_HEAD = re.compile(rb"^\s*<\?xml[^>]*\?>\s*")
#: A tag from its bracket to its end; brackets may stand in quoted values.
_TAG = re.compile(rb"""<(?:[^<>"']|"[^"]*"|'[^']*')*>""")
#: The name of a start tag, and one attribute after the other.
_NAME = re.compile(rb"<[^\s/>]+")
_ATTRIBUTE = re.compile(rb"""\s+(?P<name>[^\s=<>"'/]+)\s*=\s*(?P<value>"[^"]*"|'[^']*')""")


class _Elsewhere(ValueError):
    """An element that does not lie in the text, but comes out of an entity."""


def _value_span(text: bytes, at: int, stop: int, name: bytes) -> tuple[int, int]:
    """Where the value of an attribute of the start tag at a place lies, with its quotes."""
    at = _NAME.match(text, at).end()
    while found := _ATTRIBUTE.match(text, at, stop):
        if found["name"] == name:
            return found.span("value")
        at = found.end()
    raise _Elsewhere(name)


class _Element:
    """Where an element of a document lies: its start tag, and its whole."""

    def __init__(self, name: str, values: dict[str, str], text: bytes, at: int):
        self.name, self.values, self.at = name, values, at
        tag = _TAG.match(text, at)
        if tag is None:
            raise _Elsewhere(name)
        self.opened = tag.end()
        self.closed = self.stop = self.opened

    def is_called(self, local: str) -> bool:
        return self.name.rpartition(":")[2] == local


def _outline(text: bytes) -> list[list[_Element]]:
    """The root, its children, and the children of its first ``Pages``; raises ExpatError for what is no XML."""
    levels: list[list[_Element]] = [[], [], []]
    above: list[_Element | None] = []
    parser = expat.ParserCreate(encoding="utf-8")

    def begin(name: str, values: dict[str, str]) -> None:
        depth, element = len(above), None
        listed = depth == 2 and above[1] is not None and above[1] is next((e for e in levels[1] if e.is_called("Pages")), None)
        if depth < 2 or listed:
            element = _Element(name, values, text, parser.CurrentByteIndex)
            levels[depth].append(element)
        above.append(element)

    def end(_: str) -> None:
        element = above.pop()
        if element is not None and not text[element.at : element.opened].endswith(b"/>"):
            element.closed = parser.CurrentByteIndex
            element.stop = text.index(b">", element.closed) + 1

    parser.StartElementHandler, parser.EndElementHandler = begin, end
    parser.Parse(text, True)
    return levels


def _number(value: str | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def _renumbered(listed: Iterable[int], removed: set[int]) -> dict[int, int | None]:
    """What becomes of the numbers of pages: None for one that goes, else less by those that go before it."""
    out, gone = {}, 0
    for number in sorted(removed.union(listed)):
        if number in removed:
            gone += 1
        out[number] = None if number in removed else number - gone
    return out


def update(document: bytes, removed: set[int], pages: int) -> bytes:
    """The document without the rows of removed pages, the others renumbered, and with the new number of pages.

    Rows without a usable number stay. The number of pages is added only where pages are listed. What is not touched
    stays byte for byte, so do prefixes of namespaces. A document that is not XML comes back as it is, and so does one
    whose pages or their numbers come out of entities.
    """
    try:
        made = _spliced(document, removed, pages)
        expat.ParserCreate().Parse(made, True)
    except (expat.ExpatError, _Elsewhere):
        return document
    return made


def _spliced(document: bytes, removed: set[int], pages: int) -> bytes:
    text = _HEAD.sub(b"", document.decode("utf-8-sig", errors="replace").encode("utf-8"))
    (root, *_), top, rows = _outline(text)
    splices: list[tuple[int, int, bytes]] = []
    numbers = {row.at: _number(row.values.get("Image")) for row in rows}
    becomes = _renumbered((n for n in numbers.values() if n is not None), removed)
    for row in rows:
        number = numbers[row.at]
        if number is None:
            continue
        if becomes[number] is None:
            splices.append((row.at, row.stop, b""))
        else:
            splices.append((*_value_span(text, row.at, row.opened, b"Image"), b'"%d"' % becomes[number]))
    total = b"%d" % pages
    count = next((e for e in top if e.is_called("PageCount")), None)
    listed = next((e for e in top if e.is_called("Pages")), None)
    if count is not None and count.stop == count.opened:
        tag = text[count.at : count.opened]
        splices.append((count.at, count.stop, tag[:-2].rstrip() + b">" + total + b"</" + count.name.encode() + b">"))
    elif count is not None:
        splices.append((count.opened, count.closed, total))
    elif listed is not None:
        name = listed.name.removesuffix("Pages").encode() + b"PageCount"
        splices.append((root.closed, root.closed, b"<" + name + b">" + total + b"</" + name + b">"))
    out, at = [b'<?xml version="1.0" encoding="utf-8"?>\n'], 0
    for start, stop, new in sorted(splices):
        out += (text[at:start], new)
        at = stop
    return b"".join([*out, text[at:]])
