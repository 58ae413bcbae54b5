"""Identifiers written in several ways, and keys hashed for shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the spellings of one UUID (case, braces, urn prefix, hyphens left out).
UUID_FORM = r"^(?:urn:uuid:)?\{?([0-9a-f]{8})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{4})-?([0-9a-f]{12})\}?$"
# Fixed value: the one writing of a UUID.
UUID_PLAIN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def canonical_uuid(col: Column | str) -> Column:
    """Lower-case hyphenated form of a UUID however it is written.

    Text of any other shape (empty text too) is returned unchanged; null stays null.
    """
    c = F.col(col) if isinstance(col, str) else col
    low = F.lower(c)
    # Most identifiers are written plainly, which costs one match and no rewriting.
    return F.when(low.rlike(UUID_PLAIN), low).when(low.rlike(UUID_FORM), F.regexp_replace(low, UUID_FORM, "$1-$2-$3-$4-$5")).otherwise(c)


def key_hash(*cols: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key under different seeds, for 16-byte shuffle keys."""
    parts = [F.coalesce(c.cast("string"), F.lit("\x00")) for c in cols]
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)
