"""Unsigned 64-bit numbers held as the bit pattern of a signed long.

Bit operations work on the pattern as it is.  Order, sums and decimal text go
through the helpers here.  Sums never overflow a long: they pass through
DECIMAL(38, 0), so they also work where ANSI mode turns overflow into errors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"
TWO_64 = "18446744073709551616"
_LOW = -(2**63)


def u64_literal(value: int) -> Column:
    """The literal pattern of 0 <= value < 2**64."""
    if not 0 <= value < 2**64:
        raise ValueError(f"not an unsigned 64-bit value: {value}")
    return F.lit(value - 2**64 if value >= 2**63 else value).cast("bigint")


def u64_key(c: Column) -> Column:
    """A signed long that sorts and compares as the unsigned value does."""
    return c.bitwiseXOR(F.lit(_LOW))


def u64_dec(c: Column) -> Column:
    wide = c.cast(WIDE)
    return F.when(c < 0, wide + F.lit(TWO_64).cast(WIDE)).otherwise(wide).cast(WIDE)


def u64_from_dec(d: Column) -> Column:
    """The pattern of a decimal in 0 .. 2**64-1; null outside."""
    wide = d.cast(WIDE)
    high = wide >= F.lit(str(2**63)).cast(WIDE)
    folded = F.when(high, wide - F.lit(TWO_64).cast(WIDE)).otherwise(wide)
    return F.when((wide >= 0) & (wide < F.lit(TWO_64).cast(WIDE)), folded.cast("bigint"))


def u64_str(c: Column) -> Column:
    return u64_dec(c).cast("string")


def u64_hex(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def checked_add(a: Column, b: Column) -> Column:
    """a + b as a pattern; null where the sum leaves 64 bits."""
    return u64_from_dec(u64_dec(a) + u64_dec(b))


def wrapping_add(a: Column, b: Column) -> Column:
    """a + b modulo 2**64; ``b`` may be a signed displacement."""
    total = u64_dec(a) + u64_dec(b)
    return u64_from_dec(F.when(total >= F.lit(TWO_64).cast(WIDE), total - F.lit(TWO_64).cast(WIDE)).otherwise(total))


def saturating_add(a: Column, b: Column) -> Column:
    return F.coalesce(checked_add(a, b), F.when(a.isNotNull() & b.isNotNull(), F.lit(-1).cast("bigint")))


def page_base(c: Column) -> Column:
    return c.bitwiseAND(F.lit(~0xFFF))
