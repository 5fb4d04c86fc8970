"""Personal data: patterns propose spans, validators confirm them, context adjusts the score.

Everything is a column expression over one row, so nothing is shuffled and no Python runs.
For each kind the text is split at the pattern; the lengths of the pieces and of the hits
give the offsets in code points, and the text just before a hit, earlier hits included, is
its context. Possessive quantifiers and a look-behind keep the patterns linear on long runs; they accept the same
spans as the plain forms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsieve.llm.rows import free_name


@dataclass(frozen=True)
class Kind:
    """A kind of span. A hit scores ``prior``, plus ``bonus`` if ``words`` come shortly before it."""

    name: str
    pattern: str
    #: Java pattern that a text must hold for the kind to be looked for at all.
    needs: str
    #: SQL condition on the hit ``h``.
    valid: str
    prior: float
    bonus: float
    words: str
    #: Spans of the base stay, whatever their score.
    base: bool = True


_DIGITS = "regexp_replace(h, '[^0-9]', '')"
#: Luhn sum of the digits of h, from the right; every second one doubled.
_LUHN = (
    f"aggregate(transform(split(reverse({_DIGITS}), ''), (c, i) -> cast(c as int) * (1 + i % 2)),"
    " 0, (s, d) -> cast(s + d div 10 + d % 10 as int)) % 10 = 0"
)
_IBAN = "regexp_replace(h, '[^A-Z0-9]', '')"
#: Country and check digits go last, A is 10 to Z is 35, and the number leaves 1 when divided by 97.
_MOD97 = (
    f"aggregate(split(concat(substring({_IBAN}, 5), substring({_IBAN}, 1, 4)), ''), 0, (a, c) ->"
    " if(c between '0' and '9', (a * 10 + ascii(c) - 48) % 97, (a * 100 + ascii(c) - 55) % 97)) = 1"
)

KINDS = (
    Kind(
        "email",
        "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
        "@", "true", 0.9, 0.1, "(?i)mail|contact|write",
    ),
    Kind(
        "ip",
        "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
        "[0-9]\\.[0-9]", "not exists(split(h, '[.]'), p -> not rlike(p, '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$'))",
        0.6, 0.3, "(?i)\\bip\\b|address|host|server|login",
    ),
    Kind(
        "card",
        "[0-9](?:[\\x20-]?[0-9])++",
        "[0-9](?:[\\x20-]?[0-9]){13}", f"length({_DIGITS}) between 14 and 19 and {_LUHN}", 0.8, 0.2, "(?i)card|visa|credit|payment|account",
    ),
    Kind(
        "phone",
        "\\+[0-9][\\x20().0-9-]+[0-9]",
        "\\+[0-9]", f"length({_DIGITS}) between 10 and 15", 0.6, 0.3, "(?i)phone|tel|call|mobile|fax",
    ),
    Kind(
        "iban",
        "(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\\x20?[A-Z0-9]{4}){2,7}(?:\\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        "[A-Z]{2}[0-9]{2}\\x20?[A-Z0-9]", f"length({_IBAN}) between 15 and 34 and {_MOD97}", 0.7, 0.3, "(?i)iban|bank|account|konto|compte|cuenta",
        base=False,
    ),
    Kind(
        "card13",
        "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){12}(?![\\x20-]?[0-9])",
        "[0-9](?:[\\x20-]?[0-9]){12}", _LUHN, 0.3, 0.4, "(?i)card|visa|credit|payment",
        base=False,
    ),
    Kind(
        "ssn",
        "(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "[0-9]{3}-[0-9]{2}-", "true", 0.3, 0.4, "(?i)ssn|social security|tax id",
        base=False,
    ),
)
#: A span that is not of the base needs this score.
ACCEPT = 0.5
#: Code points before a hit in which a context word counts.
CONTEXT = 48
#: For kinds that are not of the base: after an earlier hit, this names a number of another sort, and the context begins behind that hit.
OTHER = "(?i)\\bcode\\b"
_SPANS = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,score:double>>"
#: As it is found: first and last are the places in bytes, by which a text is cut.
_FOUND = "struct<start:bigint,rank:int,stop:bigint,kind:string,score:double,first:bigint,last:bigint>"
#: Bytes that hold CONTEXT code points, and as many hits of a further kind as may lie in them.
_BYTES, _HITS = 4 * CONTEXT + 4, CONTEXT // 8


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body``, in which a name stands for a value that is found once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _before(items: str, zero: str, add: str, merge: str) -> str:
    """For each of ``items``, the sum of those before it, by ``add`` of a sum a and an item x, and ``merge`` of sums a and x.

    A list that grows within ``aggregate`` is copied for each entry, so sums are found within blocks, and over blocks. With blocks as long as the cube
    root of the number of items the work is little more than in proportion to that.
    """
    width = f"greatest(1, cast(ceil(pow(size({items}), 1D / 3)) as int))"
    blocks = f"transform(sequence(0, cast((size({items}) - 1) div w as int)), j -> slice({items}, j * w + 1, w))"
    sums = f"transform(k, b -> aggregate(b, {zero}, (a, x) -> {add}))"
    start = f"aggregate(slice(s, 1, j), {zero}, (a, x) -> {merge})"
    inside = f"transform(b, (y, i) -> aggregate(slice(b, 1, i), t, (a, x) -> {add}))"
    found = _let("w", width, _let("k", blocks, _let("s", sums, f"flatten(transform(k, (b, j) -> {_let('t', start, inside)}))")))
    return f"if(size({items}) = 0, array({zero}), {found})"


def _spans_sql(text: str, kind: Kind, rank: int) -> str:
    """SQL for the valid hits of one kind, in order; only texts that hold what the kind needs are scanned."""
    pattern = _quoted(kind.pattern)
    # A hit, the piece before it, and how long they are together, in code points and in bytes.
    hit = f"""named_struct('h', h, 'p', p, 'v', h is not null and {kind.valid}, 'o', {'false' if kind.base else f'rlike(p, {_quoted(OTHER)})'},
        'c', cast(char_length(p) + char_length(h) as bigint), 'b', cast(octet_length(p) + octet_length(h) as bigint))"""
    hits = f"filter(zip_with(regexp_extract_all({text}, {pattern}, 0), split({text}, {pattern}, -1), (h, p) -> {hit}), x -> x.h is not null)"
    sums = _before("q", "named_struct('c', 0L, 'b', 0L)", *["named_struct('c', a.c + x.c, 'b', a.b + x.b)"] * 2)
    # The context is the text before the hit, for further kinds from the last piece on that names a number of another sort.
    first = "z[n].b + octet_length(q[n].p)"
    cut = "0L" if kind.base else f"coalesce(array_max(transform(filter(sequence(greatest(0, n - {_HITS}), n), l -> q[l].o), l -> z[l].b)), 0L)"
    begin = f"greatest({cut}, {first} - {_BYTES})"
    context = f"right(cast(substring(u, cast({begin} + 1 as int), cast({first} - {begin} as int)) as string), {CONTEXT})"
    score = f"round({kind.prior}D + if(rlike({context}, {_quoted(kind.words)}), {kind.bonus}D, 0D), 2)"
    span = f"""named_struct('start', z[n].c + char_length(q[n].p), 'rank', {rank}, 'stop', z[n].c + q[n].c, 'kind', '{kind.name}', 'score', {score},
        'first', {first}, 'last', z[n].b + q[n].b)"""
    good = f"filter(sequence(0, size(q) - 1), n -> q[n].v)"
    found = f"filter(transform({good}, n -> {span}), x -> {kind.base} or x.score >= {ACCEPT}D)"
    none = f"cast(array() as array<{_FOUND}>)"
    every = _let("q", hits, f"if(size(q) = 0, {none}, {_let('z', sums, _let('u', f'cast({text} as binary)', found))})")
    return f"if(rlike({text}, {_quoted(kind.needs)}), {every}, {none})"


def _found_sql(name: str) -> str:
    every = ", ".join(_spans_sql(f"coalesce({name}, '')", k, i) for i, k in enumerate(KINDS))
    # Most texts hold neither an at sign nor a digit.
    return f"if(rlike({name}, '[0-9@]'), array_sort(concat({every})), cast(array() as array<{_FOUND}>))"


def find_pii(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with a column of spans: array<struct<start, rank, stop, kind, score>>.

    Offsets are code points, the end exclusive; spans are ordered by start, then kind as
    listed in ``KINDS``. A null or empty text has none. Other columns stay as they are; one
    named ``out_col`` is replaced. Kinds are looked for apart, so spans of two kinds may overlap.
    """
    name = "`" + text_col.replace("`", "``") + "`"
    public = "named_struct('start', s.start, 'rank', s.rank, 'stop', s.stop, 'kind', s.kind, 'score', s.score)"
    return docs.withColumn(out_col, F.expr(f"cast(transform({_found_sql(name)}, s -> {public}) as {_SPANS})"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span replaced by its kind, as in ``<EMAIL>``; overlapping spans go as one, named by the first.

    Null, empty and clean texts stay as they are, as do other columns; repeated rows are treated alike, and an empty table stays empty. The
    work grows with the length of a text and the number of its spans.
    """
    name, spans = "`" + text_col.replace("`", "``") + "`", free_name(docs, "spans")
    # A span begins another one in the output where all before it have ended; that one ends where the last before the next does.
    ends = _before("f", "-1L", "greatest(a, x.last)", "greatest(a, x)")
    heads = "filter(sequence(0, size(f) - 1), n -> f[n].first >= e[n])"
    last = "if(l + 1 < size(d), e[d[l + 1]], array_max(transform(f, x -> x.last)))"
    merged = _let("e", ends, _let("d", heads, f"transform(d, (n, l) -> named_struct('first', f[n].first, 'last', {last}, 'kind', f[n].kind))"))
    # The text between is cut out by its place in bytes.
    between = "cast(substring(u, cast({0} + 1 as int), cast({1} - {0} as int)) as string)"
    pieces = f"""concat(
        array_join(transform(m, (x, i) -> concat({between.format("if(i = 0, 0L, m[i - 1].last)", "x.first")}, '<', upper(x.kind), '>')), ''),
        {between.format("element_at(m, -1).last", "octet_length(u)")})"""
    cut = _let("f", f"`{spans}`", f"if(size(f) = 0, {name}, {_let('m', merged, _let('u', f'cast({name} as binary)', pieces))})")
    return docs.withColumn(spans, F.expr(_found_sql(name))).withColumn(text_col, F.expr(cut)).drop(spans)
