"""Lists of known junk and review packs as JSON: rules that a file must meet, all or nothing, and writing."""

from __future__ import annotations

import json
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafsieve.functions.hashing import HASH_PATTERN, hash_value, hex16, ordered
from leafsieve.operators.memory import export_known

#: Formats and limits of the files. Fixed values.
LIST_FORMAT, PACK_FORMAT, VERSION = "leafsieve-known", "leafsieve-pack", 1
MOST_ENTRIES, MOST_HASHES, MOST_PICTURE, MOST_TEXT = 20_000, 1_000, 512 * 1024, 200
#: Bytes of a file that is read.
MOST_BYTES = 1 << 28
#: Settings that a pack may carry, with their range.
SETTINGS: dict[str, tuple[int, int] | None] = {
    "threshold": (0, 16), "min_pages": (2, 999), "min_archives": (1, 999), "edge_pages": (1, 10),
    "include_flat": None, "skip_first_page": None, "skip_last_page": None,
}
ENTRY = "sid string, note string, tags string, source string, created_at double, thumbnail binary, hashes array<bigint>"


class ListError(ValueError):
    """A file that is not as it should be; nothing of it is taken."""


def _kind(of: str) -> str:
    """The kind of a JSON value: NULL, BOOLEAN, a number's, STRING, ARRAY or OBJECT."""
    return f"coalesce(nullif(regexp_extract(schema_of_variant({of}), '^[A-Z]+', 0), 'VOID'), 'NULL')"


def _items(field: str) -> str:
    return f"try_variant_get({field}, '$', 'array<variant>')"


#: Rules of any file: a condition over ``doc``, and what is wrong where it doesn't hold. A rule is asked only if those before hold.
_FILE_RULES = (
    ("doc is not null", "not JSON"),
    (f"{_kind('doc')} = 'OBJECT'", "not an object"),
    ("try_variant_get(doc, '$.format', 'string') = '{wanted}'", "not of the format {wanted}"),
    (f"{_kind('version')} in ('BIGINT', 'DECIMAL', 'DOUBLE') and try_variant_get(version, '$', 'double') = {VERSION}", "of a version that can't be read"),
)
#: Rules of a list of entries, and of each entry of it.
_LIST_RULES = ((f"{_kind('list')} = 'ARRAY'", "the entries are no list"), (f"size({_items('list')}) <= {MOST_ENTRIES}", "too many entries"))
_ENTRY_RULES = (
    (f"{_kind('entry')} = 'OBJECT'", "an entry is no object"),
    (f"{_kind('hashes')} = 'ARRAY'", "an entry without a list of hashes"),
    (f"size({_items('hashes')}) between 1 and {MOST_HASHES}", f"an entry needs 1 to {MOST_HASHES} hashes"),
    (f"forall({_items('hashes')}, h -> {_kind('h')} = 'STRING' and rlike(cast(h as string), '{HASH_PATTERN}'))", "an entry has what is no fingerprint"),
)
_SETTING_RULES = ((f"{_kind('settings')} in ('NULL', 'OBJECT')", "the settings are no object"), *(
    (
        f"try_variant_get(settings, '$.{name}', 'variant') is null or "
        + (f"{_kind(f'variant_get(settings, {chr(39)}$.{name}{chr(39)})')} = 'BOOLEAN'" if limits is None
           else f"({_kind(f'variant_get(settings, {chr(39)}$.{name}{chr(39)})')} = 'BIGINT' and variant_get(settings, '$.{name}', 'bigint') between {limits[0]} and {limits[1]})"),
        f"the setting {name} is out of its range",
    )
    for name, limits in SETTINGS.items()
))


def _demand(df: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``df``, or ListError for the first rule that a row breaks."""
    wrong = F.coalesce(*(F.when(~F.coalesce(F.expr(holds), F.lit(False)), F.lit(why)) for holds, why in rules))
    broken = df.select(wrong.alias("why")).where("why is not null").first()
    if broken:
        raise ListError(broken.why)
    return df


def _document(spark: SparkSession, path: str, wanted: str) -> DataFrame:
    """One row: the file as ``doc``. A file is one document of bounded size; a larger one is refused before it is read."""
    try:
        length = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
        if length and length > MOST_BYTES:
            raise ListError(f"{path} has {length} bytes, and {MOST_BYTES} at most are read")
        text = spark.read.text(path, wholetext=True).limit(1).collect()
    except PySparkException as failure:
        raise ListError(f"{path} can't be read") from failure
    doc = spark.createDataFrame([(text[0].value if text else "",)], "value string").selectExpr("try_parse_json(value) as doc")
    doc = doc.selectExpr("doc", "try_variant_get(doc, '$.version', 'variant') as version")
    return _demand(doc, tuple((holds.format(wanted=wanted), why.format(wanted=wanted)) for holds, why in _FILE_RULES))


def _entries(doc: DataFrame, field: str, needed: bool) -> DataFrame:
    """(number, entry, hashes: the distinct fingerprints, in unsigned order) of a list of a document; a list that is not needed may be missing or null."""
    found = doc.selectExpr(f"try_variant_get(doc, '$.{field}', 'variant') as list")
    if not needed:
        found = found.where(f"list is not null and {_kind('list')} <> 'NULL'")
    rows = _demand(found, _LIST_RULES).selectExpr(f"posexplode({_items('list')}) as (number, entry)")
    rows = _demand(rows.selectExpr("number", "entry", "try_variant_get(entry, '$.hashes', 'variant') as hashes"), _ENTRY_RULES)
    values = F.transform(F.expr(f"transform({_items('hashes')}, h -> cast(h as string))"), lambda h: ordered(hash_value(h)))
    return rows.select("number", "entry", F.transform(F.array_sort(F.array_distinct(values)), ordered).alias("hashes"))


def _text(field: str):
    return F.coalesce(F.substring(F.expr(f"try_variant_get(entry, '$.{field}', 'string')"), 1, MOST_TEXT), F.lit(""))


def _known(entries: DataFrame) -> DataFrame:
    """Rows of ENTRY. The id is the least fingerprint; a picture that is not usable is left out."""
    picture = F.expr("try_to_binary(try_variant_get(entry, '$.thumbnail', 'string'), 'base64')")
    usable = (F.octet_length(picture) <= MOST_PICTURE) & F.hex(picture).startswith("89504E47")
    return entries.orderBy("number").select(
        hex16(F.get("hashes", F.lit(0))).alias("sid"), _text("note").alias("note"), _text("tags").alias("tags"), F.lit("imported").alias("source"),
        F.lit(0.0).alias("created_at"), F.when(usable, picture).alias("thumbnail"), "hashes",
    )


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a list, as ENTRY says."""
    return _known(_entries(_document(spark, path, LIST_FORMAT), "entries", needed=True))


def read_pack(spark: SparkSession, path: str) -> tuple[dict[str, Any] | None, DataFrame, DataFrame]:
    """(settings, known entries, ignored entries (gid, note, hashes))."""
    doc = _document(spark, path, PACK_FORMAT)
    given = _demand(doc.selectExpr("try_variant_get(doc, '$.settings', 'variant') as settings"), _SETTING_RULES)
    row = given.selectExpr(*(f"try_variant_get(settings, '$.{n}', '{'boolean' if limits is None else 'int'}') as {n}" for n, limits in SETTINGS.items())).first()
    settings = {n: v for n, v in row.asDict().items() if v is not None}
    ignored = _entries(doc, "ignored", needed=False).select(hex16(F.get("hashes", F.lit(0))).alias("gid"), _text("note").alias("note"), "hashes")
    return settings or None, _known(_entries(doc, "known", needed=False)), ignored


def setting_changes(current: dict[str, Any], proposed: dict[str, Any] | None) -> list[tuple[str, Any, Any]]:
    return [(k, current.get(k), v) for k, v in (proposed or {}).items() if k in SETTINGS and current.get(k) != v]


def write_known(known: DataFrame, hashes: DataFrame, path: str) -> None:
    """A list of at most 20,000 entries, as a file of one document."""
    rows = [r.asDict() for r in export_known(known, hashes).orderBy("id").limit(MOST_ENTRIES + 1).collect()]
    _write(path, {"format": LIST_FORMAT, "version": VERSION, "entries": rows}, len(rows))


def write_pack(known: DataFrame, hashes: DataFrame, ignored: DataFrame, settings: dict[str, Any] | None, path: str) -> None:
    """``ignored`` is (gid, note, hashes: array<string>); only settings that a pack may carry go."""
    rows = [r.asDict() for r in export_known(known, hashes).orderBy("id").limit(MOST_ENTRIES + 1).collect()]
    left = [{"id": r.gid, "note": r.note, "hashes": sorted(r.hashes)} for r in ignored.orderBy("gid").limit(MOST_ENTRIES + 1).collect()]
    chosen = {k: settings[k] for k in SETTINGS if k in settings} if settings else None
    _write(path, {"format": PACK_FORMAT, "version": VERSION, "settings": chosen, "known": rows, "ignored": left}, max(len(rows), len(left)))


def _write(path: str, payload: dict, entries: int) -> None:
    if entries > MOST_ENTRIES:
        raise ListError("too many entries for a list")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(payload, file, indent=1)
