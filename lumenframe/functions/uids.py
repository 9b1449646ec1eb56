"""Columns over UIDs: validity and derived UIDs, computed in the JVM on 32-bit limbs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTERED = "1.2.840.10008."


def is_valid(uid: Column) -> Column:
    return uid.rlike(r"^(0|[1-9][0-9]*)(\.(0|[1-9][0-9]*))*$") & (F.length(uid) <= 64)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: inside other lambdas common parts are not shared."""
    return F.transform(F.array(value), use)[0]


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _half(digits: Column, at: int) -> Column:
    """16 hex digits from a place, as the 64 bits of a long."""
    return F.conv(F.substring(digits, at, 16), 16, -10).cast("long")


def _decimal(hi: Column, lo: Column) -> Column:
    """The decimal form of the unsigned number of 128 bits in two longs.

    Its four parts of 32 bits are spread over limbs of nine digits by what 2^96, 2^64 and 2^32 are in them; no sum
    leaves a long. In a projection of its own its common parts are computed once.
    """
    div = lambda x, y: F.call_function("div", x, y)
    base, low32 = _long(10**9), _long(0xFFFFFFFF)
    a, b, c, d = F.shiftrightunsigned(hi, 32), hi.bitwiseAND(low32), F.shiftrightunsigned(lo, 32), lo.bitwiseAND(low32)
    d0 = a * _long(543950336) + b * _long(709551616) + c * _long(294967296) + d
    d1 = a * _long(264337593) + b * _long(446744073) + c * _long(4) + div(d0, base)
    d2 = a * _long(228162514) + b * _long(18) + div(d1, base)
    d3 = a * _long(79) + div(d2, base)
    low, middle = (d1 % base) * base + d0 % base, (d3 % base) * base + d2 % base
    lead = F.concat(div(d3, base).cast("string"), F.lpad(middle.cast("string"), 18, "0"), F.lpad(div(low, _long(10)).cast("string"), 17, "0"))
    return F.concat(F.ltrim(lead, F.lit("0")), (low % _long(10)).cast("string"))


def _bound(first: Column, second: Column, use: Callable[[Column, Column], Column]) -> Column:
    return _once(F.struct(first.alias("a"), second.alias("b")), lambda s: use(s["a"], s["b"]))


def decimal_of_hex(digits: Column) -> Column:
    """The decimal form of 32 hex digits."""
    return _bound(_half(digits, 1), _half(digits, 17), _decimal)


def _bytes(digits: Column, order: list[int]) -> Column:
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in order])


SWAPPED = [3, 2, 1, 0, 5, 4, 7, 6, 8, 9, 10, 11, 12, 13, 14, 15]


def _upper(x: Column) -> Column:
    """The first eight bytes in the order of SWAPPED, with version 5."""
    byte = [F.shiftrightunsigned(x, 56 - 8 * i).bitwiseAND(_long(0xFF)) for i in range(8)]
    byte[6] = byte[6].bitwiseAND(_long(0x0F)).bitwiseOR(_long(0x50))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(byte[i], 56 - 8 * at) for at, i in enumerate(SWAPPED[:8])])


def _lower(y: Column) -> Column:
    """The last eight bytes, with the variant of a UUID."""
    return y.bitwiseAND(_long(0x3FFFFFFFFFFFFFFF)).bitwiseOR(_long(-(2**63)))


def with_derived(rows: DataFrame, name: str, seed: Column) -> DataFrame:
    """rows with from_seed(seed) as a column, at a fifth of its time: in steps of their own, without lambdas; null for null."""
    steps = rows.withColumn("_h", F.sha2(seed, 256)).withColumns({"_x": _half(F.col("_h"), 1), "_y": _half(F.col("_h"), 17)})
    steps = steps.withColumns({"_hi": _upper(F.col("_x")), "_lo": _lower(F.col("_y"))})
    return steps.withColumn(name, F.concat(F.lit("2.25."), _decimal(F.col("_hi"), F.col("_lo")))).drop("_h", "_x", "_y", "_hi", "_lo")


def from_seed(seed: Column) -> Column:
    """2.25.<n> from the SHA-256 of a seed, marked as a UUID of version 5; the same seed always gives the same UID."""
    halves = lambda h: _bound(_half(h, 1), _half(h, 17), lambda x, y: _bound(_upper(x), _lower(y), _decimal))
    return F.concat(F.lit("2.25."), _once(F.sha2(seed, 256), halves))


def from_uuid(uuid: Column) -> Column:
    """2.25.<n> of a UUID in text, as the standard has it: its hex digits as one number."""
    return F.concat(F.lit("2.25."), decimal_of_hex(F.lower(F.replace(uuid, F.lit("-"), F.lit("")))))


def from_uuid_little_endian(uuid: Column) -> Column:
    """2.25.<n> of the bytes of a UUID in the mixed order of its fields, read as a little-endian number."""
    digits = F.lower(F.replace(uuid, F.lit("-"), F.lit("")))
    return F.concat(F.lit("2.25."), _once(_bytes(digits, SWAPPED[::-1]), decimal_of_hex))


def from_name(root: Column, name: Column) -> Column:
    """root.<n>: the first 16 bytes of the SHA-256 of a name as a little-endian number, cut to 64 characters."""
    digits = _once(F.sha2(name, 256), lambda h: _bytes(h, list(range(15, -1, -1))))
    return F.substring(F.concat(root, F.lit("."), _once(digits, decimal_of_hex)), 1, 64)
