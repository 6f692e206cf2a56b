"""Sortable names: 48 bits of time and 80 bits of entropy as 26 base-32 characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Crockford's base-32 alphabet (fixed value).
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(value: Column, n: int) -> Column:
    """The lowest 5 * n bits of a long, as n characters."""
    return F.concat(*[F.substring(F.lit(ALPHABET), (F.shiftrightunsigned(value, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for i in reversed(range(n))])


def ulid(at_ms: Column, entropy_hex: Column) -> Column:
    """The name of an instant and 20 hex digits of entropy; the instant is cut to 48 bits."""
    half = lambda at: F.conv(F.substring(entropy_hex, at, 10), 16, 10).cast("long")
    return F.concat(_base32(at_ms.bitwiseAND((1 << 48) - 1), 10), _base32(half(1), 8), _base32(half(11), 8))


def ulid_millis(text: Column) -> Column:
    """The instant in a name of either case; null where the text is no such name."""
    upper = F.upper(text)
    time = F.lit(0).cast("long")
    for i in range(10):
        time = time * 32 + F.instr(F.lit(ALPHABET), F.substring(upper, i + 1, 1)) - 1
    return F.when(upper.rlike(f"^[0-7][{ALPHABET}]{{25}}$"), time)
