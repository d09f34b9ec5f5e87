"""Hashes and fingerprints (H1-H5) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FNV-1a for 32 bits.
OFFSET, PRIME, MASK = 2166136261, 16777619, 4294967295


def _fold(units: Column) -> Column:
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(PRIME).cast("long")).bitwiseAND(F.lit(MASK).cast("long"))
    return F.aggregate(units, F.lit(OFFSET).cast("long"), step)


def fnv1a32(c: Column) -> Column:
    """H1: FNV-1a over UTF-16 units as hexadecimal digits without leading zeros; null for null.

    Texts without characters beyond 16 bits take a fast split; others go through their UTF-16 bytes.
    """
    fast = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    wide = F.transform(F.regexp_extract_all(F.hex(F.encode(c, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("long"))
    value = F.when(c == "", F.lit(OFFSET)).when(c.rlike("[^\\x{0}-\\x{FFFF}]"), _fold(wide)).otherwise(_fold(fast))
    return F.when(c.isNotNull(), F.lower(F.hex(value)))


def multiset_hash(keys: Column) -> Column:
    """H2: a hash of an array's values that their order does not change."""
    return F.xxhash64(F.array_sort(keys))


def content_hash(c: Column) -> Column:
    """H3: SHA-256 of text or bytes."""
    return F.sha2(c.cast("binary"), 256)


def tenant_id(token: Column) -> Column:
    """H5."""
    return F.concat(F.lit("t"), fnv1a32(token))
