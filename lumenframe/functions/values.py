"""Columns over values: padding, multiplicity, dates, times and numbers in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = "\\"


def trim_padding(s: Column) -> Column:
    return F.regexp_replace(s, "[ \\x00]+$", "")


def split_values(s: Column) -> Column:
    return F.split(s, r"\\", -1)


def count_values(s: Column) -> Column:
    """The number of values, without splitting."""
    return F.length(s) - F.length(F.replace(s, F.lit(BACKSLASH), F.lit(""))) + 1


def first_value(s: Column) -> Column:
    return F.element_at(split_values(s), 1)


def _date(s: Column, pattern: str) -> Column:
    return F.try_to_date(s, pattern) if hasattr(F, "try_to_date") else F.try_to_timestamp(s, F.lit(pattern)).cast("date")


def parse_da(s: Column) -> Column:
    """A date in the form yyyyMMdd, or with separators as old files have it; null for anything else."""
    v = trim_padding(first_value(s))
    return F.when(v.startswith("0000"), None).when(v.rlike("^[0-9]{8}$"), _date(v, "yyyyMMdd")).when(v.rlike(r"^[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}$"), _date(F.translate(v, ".", "-"), "yyyy-MM-dd"))


def parse_tm(s: Column) -> Column:
    """Microseconds of the day of HH[MM[SS[.F{1,6}]]]; null for anything else."""
    v = trim_padding(first_value(s))
    part = lambda at: F.coalesce(F.substring(v, at, 2).try_cast("long"), F.lit(0).cast("long"))
    fraction = F.rpad(F.regexp_extract(v, r"\.([0-9]{1,6})$", 1), 6, "0").try_cast("long")
    good = v.rlike(r"^([01][0-9]|2[0-3])([0-5][0-9]([0-5][0-9](\.[0-9]{1,6})?)?)?$")
    return F.when(good, ((part(1) * 60 + part(3)) * 60 + part(5)) * 1_000_000 + F.coalesce(fraction, F.lit(0).cast("long")))


def parse_dt(s: Column) -> Column:
    """struct(micros, offset): microseconds since 1970 of the local date and time, and the offset from UTC in minutes."""
    v = trim_padding(first_value(s))
    offset = F.regexp_extract(v, r"([+-][0-9]{4})$", 1)
    local = F.regexp_replace(v, "[+-][0-9]{4}$", "")
    good = local.rlike(r"^[0-9]{8}([0-9]{2}([0-9]{2}([0-9]{2}(\.[0-9]{1,6})?)?)?)?$")
    days = F.datediff(_date(F.substring(local, 1, 8), "yyyyMMdd"), F.lit("1970-01-01").cast("date")).cast("long")
    rest = F.substring(local, 9, 20)
    time = F.when(rest == "", F.lit(0).cast("long")).otherwise(parse_tm(rest))
    minutes = F.when(offset != "", (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 4, 2).cast("int")) * F.when(offset.startswith("-"), -1).otherwise(1))
    return F.struct(F.when(good, days * 86_400_000_000 + time).alias("micros"), minutes.alias("offset"))


def parse_int(s: Column) -> Column:
    return F.trim(first_value(s)).try_cast("int")


def parse_double(s: Column) -> Column:
    return F.trim(first_value(s)).try_cast("double")


def parse_ints(s: Column) -> Column:
    """All values; those that aren't integers are left out."""
    return F.filter(F.transform(split_values(s), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def parse_doubles(s: Column) -> Column:
    return F.filter(F.transform(split_values(s), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())


def even_length(n: Column) -> Column:
    return n + n % 2


def even_pad(s: Column, pad: Column) -> Column:
    return F.when(F.octet_length(s) % 2 == 1, F.concat(s, pad)).otherwise(s)


def encoded_length(vr: Column, value_length: Column, explicit: Column) -> Column:
    """Bytes of an element: its head, and its value padded to an even number."""
    from .tags import has_long_length

    return F.when(explicit & has_long_length(vr), 12).otherwise(8) + even_length(value_length)


def query_range(start: Column, end: Column) -> Column:
    """A date range key: yyyyMMdd-yyyyMMdd, open at a null end."""
    show = lambda d: F.coalesce(F.date_format(d, "yyyyMMdd"), F.lit(""))
    return F.concat(show(start), F.lit("-"), show(end))


def creator_key(s: Column) -> Column:
    return F.upper(F.trim(s))


def charset_term(s: Column) -> Column:
    return F.replace(F.replace(F.upper(F.trim(s)), F.lit("ISO IR "), F.lit("ISO_IR ")), F.lit("ISO-IR "), F.lit("ISO_IR "))


def keyword(name: Column) -> Column:
    """CamelCase of a name: letters and digits, the first of each word in upper case."""
    words = F.filter(F.split(F.regexp_replace(name, "[^A-Za-z0-9]+", " "), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000))), "")


def ae_title_ok(s: Column) -> Column:
    return s.rlike("^[!-~]([ -~]{0,14}[!-~])?$")


def wildcard(s: Column, pattern: str) -> Column:
    """Matching with * for any run and ? for any one character."""
    escaped = pattern.replace("\\", r"\\").replace("%", r"\%").replace("_", r"\_")
    return s.like(escaped.replace("*", "%").replace("?", "_"))


def status_category(code: Column) -> Column:
    return (
        F.when(code == 0x0000, "Success").when(code == 0xFE00, "Cancel").when(code.isin(0xFF00, 0xFF01), "Pending").when(code.between(0xB000, 0xBFFF), "Warning").otherwise("Failure")
    )


def is_response(field: Column) -> Column:
    return field.bitwiseAND(F.lit(0x8000)) != 0


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(percent, eta): percent done, and seconds to go at the rate so far."""
    percent = F.when(total > 0, done * 100.0 / total).otherwise(0.0)
    return F.struct(percent.alias("percent"), F.when((done > 0) & (seconds > 0), (total - done) * seconds / done).alias("eta"))


def frame_bytes(rows: Column, cols: Column, samples: Column, bits: Column) -> Column:
    return rows.cast("long") * cols * samples * F.floor((F.coalesce(bits, F.lit(16)) + 7) / 8)


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    """8-bit colours by BT.601, rounded by truncation after adding a half."""
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (x + 0.5).cast("int")))
    return [clamp(y + 1.402 * (cr - 128)), clamp(y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)), clamp(y + 1.772 * (cb - 128))]


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> list[Column]:
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), (x + 0.5).cast("int")))
    y = clamp(0.299 * r + 0.587 * g + 0.114 * b)
    return [y, clamp((b - y) / 1.772 + 128), clamp((r - y) / 1.402 + 128)]


def rct(r: Column, g: Column, b: Column) -> list[Column]:
    """The reversible colour transform in integers."""
    return [F.shiftright(r + 2 * g + b, 2), b - g, r - g]


def inverse_rct(y: Column, u: Column, v: Column) -> list[Column]:
    g = y - F.shiftright(u + v, 2)
    return [v + g, g, u + g]


def wide_ycbcr_to_rgb(y: Column, cb: Column, cr: Column, most: int) -> list[Column]:
    """Colours of more than 8 bits, most being the largest sample: chroma is centred at half of it, rounded down."""
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(most), (x + 0.5).cast("int")))
    u, v = cb - most // 2, cr - most // 2
    return [clamp(y + 1.402 * v), clamp(y - 0.344136 * u - 0.714136 * v), clamp(y + 1.772 * u)]


#: The irreversible colour transform of JPEG 2000 and its inverse.
ICT = [[0.299, 0.587, 0.114], [-0.16875, -0.33126, 0.5], [0.5, -0.41869, -0.08131]]
INVERSE_ICT = [[1.0, 0.0, 1.402], [1.0, -0.34413, -0.71414], [1.0, 1.772, 0.0]]


def _weighted(weights: list[list[float]], a: Column, b: Column, c: Column) -> list[Column]:
    return [w[0] * a + w[1] * b + w[2] * c for w in weights]


def ict(r: Column, g: Column, b: Column) -> list[Column]:
    """The irreversible colour transform, not rounded: luminance and two differences."""
    return _weighted(ICT, r, g, b)


def inverse_ict(y: Column, cb: Column, cr: Column) -> list[Column]:
    return _weighted(INVERSE_ICT, y, cb, cr)
