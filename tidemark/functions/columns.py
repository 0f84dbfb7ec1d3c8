"""Scalar helpers as column expressions, with the same results as their Python twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..advice.catalog import CATEGORIES

BLANKS = " \t\n\r\f\v"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def ascii_upper(text: Column) -> Column:
    return F.translate(text, _LOWER, _UPPER)


def trim_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def parse_uint(text: Column) -> Column:
    """Whole numbers of digits alone that fit 63 bits; null otherwise."""
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long"))


def parse_double(text: Column) -> Column:
    return F.when(text.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"), text.try_cast("double"))


def to_hex(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def from_hex(text: Column) -> Column:
    """The number as decimal text, since it may need all 64 bits; null unless 1 to 16 hex digits."""
    return F.when(text.rlike(r"\A[0-9A-Fa-f]{1,16}\z"), F.conv(text, 16, 10))


def _fixed(number: Column, digits: int, unit: str = "") -> Column:
    """A number with so many decimals; ties go to the even digit, as in Python (and unlike in ``format_string``)."""
    return F.format_string(f"%.{digits}f{unit}", F.bround(number, digits))


def format_count(number: Column) -> Column:
    return F.format_number(number, 0)


def format_compact(number: Column) -> Column:
    """Three digits or so and a letter for thousands, millions and so on."""
    n = number.cast("double")
    small = F.when((n < 10) & (n != F.floor(n)), _fixed(n, 1)).otherwise(_fixed(n, 0))
    out = F.when(n < 1000, small)
    for k, letter in enumerate("kMBT", 1):
        part = n / float(1000**k)
        text = F.when(part < 100, _fixed(part, 1, letter)).otherwise(_fixed(part, 0, letter))
        out = out.when((part < 1000) | F.lit(letter == "T"), text)
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.lit("-")).otherwise(out)


def format_duration(seconds: Column) -> Column:
    """Microseconds to days, with the unit that suits the size."""
    s = seconds.cast("double")
    out = F.when(F.isnan(s) | (s == float("inf")) | (s < 0), F.lit("-"))
    for below, scale, digits, unit in ((1e-3, 1e6, 0, "µs"), (0.1, 1e3, 1, "ms"), (1.0, 1e3, 0, "ms"), (10.0, 1.0, 2, "s"), (60.0, 1.0, 1, "s")):
        out = out.when(s < below, _fixed(s * scale, digits, f" {unit}"))
    whole = F.floor(s + 0.5).cast("long")
    for below, big, small, names in ((3600, 60, 1, "ms"), (86400, 3600, 60, "hm"), (None, 86400, 3600, "dh")):
        text = F.format_string(f"%d{names[0]} %02d{names[1]}", F.floor(whole / big).cast("long"), F.floor(whole % big / small).cast("long"))
        out = out.when(whole < below, text) if below else out.otherwise(text)
    return out


def split_text(text: Column, separator: str) -> Column:
    """The parts between a separator of one character, empty ones included."""
    return F.split(text, rf"\Q{separator}\E", -1)


def join_texts(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def crc32(text: Column) -> Column:
    return F.crc32(text.cast("binary"))


def format_bytes(number: Column) -> Column:
    out = F.concat(number.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(number >= 1024**k, _fixed(number / float(1024**k), 1, f" {unit}")).otherwise(out)
    return out


def format_timestamp(seconds: Column) -> Column:
    """UTC, whatever the session's zone."""
    return F.date_format(F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), "yyyy-MM-dd HH:mm:ss")


def abbreviate(text: Column, limit: int) -> Column:
    flat = F.regexp_replace(trim_blanks(text), r"[ \t\n\r\f\x0B]+", " ")
    return F.when(F.char_length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def type_category(kind: Column) -> Column:
    word = ascii_lower(F.regexp_extract(kind, r"\A[ \t]*([A-Za-z]+)(?=[( ]|\z)", 1))
    out = F.lit("other")
    for category, names in CATEGORIES.items():
        out = F.when(word.isin(*names.split()), category).otherwise(out)
    return out
