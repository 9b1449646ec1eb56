"""Columns over tags: a tag is group * 65536 + element as a long."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import LONG_LENGTH_VRS, NUMERIC_VRS, STRING_VRS


def group(tag: Column) -> Column:
    return F.shiftright(tag, 16).cast("int")


def element(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(0xFFFF)).cast("int")


def is_private(tag: Column) -> Column:
    return group(tag) % 2 == 1


def is_private_creator(tag: Column) -> Column:
    return is_private(tag) & element(tag).between(0x01, 0xFF)


def slot(tag: Column) -> Column:
    """The block that a private element belongs to: a creator's own number, a data element's high byte; null otherwise."""
    return F.when(is_private_creator(tag), element(tag)).when(is_private(tag), F.shiftright(element(tag), 8))


def block(tag: Column) -> Column:
    """Group and slot of a private element as one number."""
    return F.shiftright(tag, 16) * 65536 + slot(tag)


def show(tag: Column) -> Column:
    return F.when(tag.isNotNull(), F.format_string("(%04X,%04X)", group(tag), element(tag)))


def to_hex(tag: Column) -> Column:
    return F.lpad(F.hex(tag), 8, "0")


def parse(text: Column) -> Column:
    """The tag of "(GGGG,EEEE)" or "GGGGEEEE"; null for anything else."""
    digits = F.regexp_extract(F.trim(text), r"^(?:\(([0-9A-Fa-f]{4}),([0-9A-Fa-f]{4})\)|([0-9A-Fa-f]{8}))$", 0)
    return F.when(digits != "", F.conv(F.regexp_replace(digits, "[(),]", ""), 16, 10).cast("long"))


def matches(tag: Column, mask: Column, card: Column) -> Column:
    return tag.bitwiseAND(mask) == card


def parse_pattern(text: Column) -> tuple[Column, Column]:
    """Mask and card of a pattern such as "(50xx,0010)", in which x stands for any digit."""
    digits = F.regexp_replace(F.upper(text), "[(),]", "")
    number = lambda c: F.conv(c, 16, 10).cast("long")
    mask = number(F.translate(F.translate(digits, "0123456789ABCDEF", "FFFFFFFFFFFFFFFF"), "X", "0"))
    return mask, number(F.translate(digits, "X", "0"))


def is_string(vr: Column) -> Column:
    return vr.isin(STRING_VRS)


def is_numeric(vr: Column) -> Column:
    return vr.isin(NUMERIC_VRS)


def has_long_length(vr: Column) -> Column:
    return vr.isin(LONG_LENGTH_VRS)


def resolve_vr(tag: Column, default: Column, bits_allocated: Column, pixel_representation: Column) -> Column:
    """The representation of an attribute that may have two, from its context."""
    pixels = tag == 0x7FE00010
    either = tag.isin(0x00280106, 0x00280107, 0x00280120)
    return F.when(pixels, F.when(bits_allocated > 8, "OW").otherwise("OB")).when(either, F.when(pixel_representation == 1, "SS").otherwise("US")).otherwise(default)


def vm_range(vm: Column) -> tuple[Column, Column]:
    """Least and most values of a multiplicity such as "1", "1-3", "2-2n" or "n"; "n" is any number up to 65535."""
    low = F.coalesce(F.regexp_extract(vm, r"^(\d+)", 1).try_cast("int"), F.lit(1))
    high = F.when(F.lower(vm).contains("n"), 65535).otherwise(F.coalesce(F.regexp_extract(vm, r"-(\d+)$", 1).try_cast("int"), low))
    return low, high


def vm_ok(count: Column, vm: Column) -> Column:
    low, high = vm_range(vm)
    return count.between(low, high)
