"""Scalar expressions over trace values; all stay in whole-stage code but ``strict_object``."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.u64 import WIDE, checked_add, u64_dec, wrapping_add
from tracelake.plans.session import ship

REGISTERS = 34
NO_REGISTER = 255
FNV_START, FNV_PRIME = 2166136261, 16777619  # fixed values of 32-bit FNV-1a


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mask_slots(mask: Column, bits: int = REGISTERS) -> Column:
    """Indexes of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(mask, i) == 1)


def popcount(mask: Column) -> Column:
    return F.bit_count(mask)


def width_mask(width: Column) -> Column:
    """All-ones over ``width`` bytes: 1 to 8; null otherwise."""
    shifted = F.call_function("shiftleft", F.lit(1).cast("bigint"), (width * 8).cast("int")) - 1
    return F.when(width == 8, F.lit(-1).cast("bigint")).when(width.between(1, 7), shifted)


def truncate_value(value: Column, size: Column) -> Column:
    """The low ``size`` bytes of a value; values of 8 bytes and more are whole."""
    return F.when(size >= 8, value).otherwise(value.bitwiseAND(width_mask(size)))


def little_endian(value: Column, size: Column) -> Column:
    """The low ``size`` (at most 8) bytes of a value, least significant first."""
    hex16 = F.lpad(F.hex(value), 16, "0")
    swapped = F.concat(*[F.substring(hex16, 15 - 2 * i, 2) for i in range(8)])
    return F.unhex(F.substring(swapped, F.lit(1), F.least(size, F.lit(8)) * 2))


def errno(raw: Column) -> Column:
    """The positive error number of a raw kernel return in -4095 .. -1, else null."""
    return F.when(raw.between(-4095, -1), -raw)


def fixed_six(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator cut to six digits after the point; a zero denominator gives 0.000000."""
    n, d = numerator.cast(WIDE), denominator.cast(WIDE)
    some = F.when(d != 0, d)
    rest = F.pmod(n, some)  # taken off first, so that both quotients are whole
    whole = ((n - rest) / some).cast(WIDE)
    parts = rest * 1_000_000
    millionths = ((parts - F.pmod(parts, some)) / some).cast("decimal(7,0)")
    exact = whole.cast("decimal(31,0)") + (millionths / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(7,6)")
    return F.when(d == 0, F.lit("0.000000").cast("decimal(38,6)")).otherwise(exact.cast("decimal(38,6)"))


def bounded_display(text: Column, limit: int) -> Column:
    """Control characters as spaces, at most ``limit`` UTF-8 bytes (whole code points), trimmed."""
    plain = F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")
    cut = F.substring(plain, 1, limit)
    longest = F.filter(F.sequence(F.lit(0), F.lit(limit)), lambda n: F.octet_length(F.substring(plain, F.lit(1), n)) <= limit)
    short = F.substring(plain, F.lit(1), F.element_at(longest, -1))
    return F.trim(F.when(F.octet_length(plain) <= limit, plain).when(F.octet_length(cut) <= limit, cut).otherwise(short))


def json_quote(text: Column) -> Column:
    """A JSON string literal; characters beyond ASCII stay readable."""
    wrapped = F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("v")))
    return F.regexp_extract(wrapped, r"(?s)^\{\"v\":(.*)\}$", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_hex64(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^0x[0-9a-f]{1,16}$"), F.lit(False))


def parse_hex64(text: Column) -> Column:
    """The pattern of a ``0x`` text of 1 to 16 lower-case digits; null for anything else."""
    digits = F.lpad(F.substring(text, 3, 16), 16, "0")
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return F.when(is_hex64(text), F.shiftleft(high, 32).bitwiseOR(low))


def fnv32(data: Column) -> Column:
    """32-bit FNV-1a of binary ``data``, as a long."""
    digits = F.hex(data)
    places = F.sequence(F.lit(0), F.octet_length(data) - 1)
    step = lambda h, i: F.pmod(
        h.bitwiseXOR(F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")) * FNV_PRIME, F.lit(2**32)
    )
    return F.when(F.octet_length(data) == 0, F.lit(FNV_START).cast("bigint")).otherwise(F.aggregate(places, F.lit(FNV_START).cast("bigint"), step))


def extended_index(value: Column, extend: Column, shift: Column) -> Column:
    """An index register's value as an address part: extend 0 none, 1 UXTW, 2 SXTW, 3 LSL, 4 SXTX; then shifted."""
    low = value.bitwiseAND(F.lit(0xFFFFFFFF))
    signed = F.when(low >= 2**31, low - 2**32).otherwise(low)
    chosen = F.when(extend == 1, low).when(extend == 2, signed).otherwise(value)
    return F.call_function("shiftleft", chosen, shift.cast("int"))


def effective_address(registers: Column, operand: Column) -> Column:
    """base + extended index + displacement modulo 2**64 over a register array; post-index adds nothing to the base."""
    zero = F.lit(0).cast("bigint")
    base = F.when(operand["base"] == NO_REGISTER, zero).otherwise(F.get(registers, operand["base"].cast("int")))
    index = F.when(operand["index"] == NO_REGISTER, zero).otherwise(
        extended_index(F.get(registers, operand["index"].cast("int")), operand["extend"], operand["shift"])
    )
    whole = wrapping_add(wrapping_add(base, index), operand["displacement"])
    return F.when(operand["address_mode"] == 2, base).otherwise(whole)


def writeback_address(registers: Column, operand: Column) -> Column:
    """The base register's value after a pre- or post-indexed access; null without writeback."""
    base = F.get(registers, operand["base"].cast("int"))
    return F.when((operand["writeback"] == 1) & (operand["base"] != NO_REGISTER), wrapping_add(base, operand["displacement"]))


def address_in_module(address: Column, base: Column, size: Column) -> Column:
    distance = u64_dec(address) - u64_dec(base)
    return F.coalesce((distance >= 0) & (distance < u64_dec(size)), F.lit(False))


def offset_to_address(base: Column, offset: Column, size: Column) -> Column:
    return F.when(u64_dec(offset) < u64_dec(size), checked_add(base, offset))


def _strict(text: str | None, keys: frozenset[str]) -> bool:
    def pairs(found: list) -> dict:
        if len({k for k, _ in found}) != len(found):
            raise ValueError("duplicate key")
        return dict(found)

    try:
        value = json.loads(text, object_pairs_hook=pairs)
    except (TypeError, ValueError):
        return False
    return isinstance(value, dict) and value.keys() == keys


def strict_object(text: Column, keys: frozenset[str]) -> Column:
    """Whether a text is a JSON object with exactly these keys, none of them twice at any level.

    No built-in function sees duplicate keys, so this alone is an Arrow-batched UDF.
    """

    if (session := SparkSession.getActiveSession()) is not None:
        ship(session)

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _strict(v, keys))

    return check(text)
