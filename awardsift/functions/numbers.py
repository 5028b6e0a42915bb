"""Amounts, labels and the hash shared by sampling, splitting and embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as a number once "$" and "," are gone: digits may be grouped by single "_",
# blanks around are fine, and infinity is a number. "12d" or "0x1F" are not.
_DIGITS = r"\d(?:_?\d)*"
NUMBER = rf"^\s*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?|(?i:inf(?:inity)?))\s*$"


def amount(text: Column) -> Column:
    """A text as a double, "$" and "," left out; null where it is no number."""
    bare = F.translate(text, "$,", "")
    return F.when(bare.rlike(NUMBER), F.replace(F.trim(bare), F.lit("_"), F.lit("")).try_cast("double"))


def normalize_value(value: Column, kind: str = "string") -> Column:
    """Amount as a double; null, NaN and texts that are no number give 0."""
    number = amount(value) if kind == "string" else value.cast("double")
    return F.coalesce(F.nanvl(number, F.lit(0.0)), F.lit(0.0))


def money(value: Column) -> Column:
    """'$1,234', rounded to whole dollars."""
    return F.concat(F.lit("$"), F.format_number(value, 0))


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when there is no whole."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))


def hash01(text: Column) -> Column:
    """The first 32 bits of md5 as a fraction in [0, 1)."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def run_stamp(moment: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if moment is None else moment, "yyyyMMddHHmmss")
