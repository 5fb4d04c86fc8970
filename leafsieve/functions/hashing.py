"""64-bit fingerprints as signed longs whose bits are unsigned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafsieve.options import BITS

_SIGN = -(1 << 63)


def content_digest(content: Column) -> Column:
    """SHA-256 of bytes or of a text in UTF-8, in hex."""
    return F.sha2(content.cast("binary"), 256)


def hex16(h: Column) -> Column:
    """16 lower-case hex digits; their order is the unsigned order."""
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def from_hex16(text: Column) -> Column:
    return F.conv(text, 16, -10).cast("long")


def ordered(h: Column) -> Column:
    """A long whose signed order is the unsigned order of ``h``; applied twice it gives ``h``."""
    return h.bitwiseXOR(F.lit(_SIGN))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: 16 characters that are a number to base 16: digits, single low lines between them, and before them blanks, a plus sign or 0x.
HASH_PATTERN = r"^(?=.{16}$)[ \t\n]*[+]?(0[xX]_?)?[0-9a-fA-F]+(_[0-9a-fA-F]+)*[ \t\n]*$"


def hash_value(text: Column) -> Column:
    """The fingerprint that a text of HASH_PATTERN spells."""
    return from_hex16(F.lpad(F.regexp_replace(F.regexp_replace(text, r"^[ \t\n]*[+]?(0[xX])?|[ \t\n]+$", ""), "_", ""), 16, "0"))


def parse_hash(text: Column) -> Column:
    """The fingerprint that 16 characters spell as a number to base 16, else null."""
    return F.when(text.rlike(HASH_PATTERN), hash_value(text))


def bands(threshold: int) -> list[tuple[int, int]]:
    """(offset, width) of threshold + 1 disjoint bands; the first ones take the bits left over.

    Fingerprints that differ in at most ``threshold`` bits agree in one of them.
    """
    width, over = divmod(BITS, threshold + 1)
    cuts = [0]
    for k in range(threshold + 1):
        cuts.append(cuts[-1] + width + (k < over))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def band_keys(h: Column, threshold: int) -> Column:
    """array<struct<band, key>> of a fingerprint."""
    return F.array(*(
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(h, o).bitwiseAND(F.lit((1 << w) - 1 if w < BITS else -1)).alias("key"))
        for k, (o, w) in enumerate(bands(threshold))
    ))


def dhash_of_bits(bits: Column) -> Column:
    """A fingerprint of an array of 64 booleans, the first one highest."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit.cast("long")))
