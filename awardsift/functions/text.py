"""Description text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Anything that is not a letter, a number or "_". White space and punctuation both become one
# space, so one pass over the text does the work of "blank out, then collapse".
NOT_WORD = r"[^\p{L}\p{N}_]+"


def clean_text(text: Column) -> Column:
    """Lower-cased words separated by single spaces; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), F.lit(""))


def word_count(clean: Column) -> Column:
    """Number of words of a cleaned text, counted by its spaces (no array is built)."""
    spaces = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean == "", F.lit(0)).otherwise(spaces + 1)


def value_per_word(value: Column, clean: Column) -> Column:
    return value / F.greatest(word_count(clean), F.lit(1))


def truncate(text: Column, width: int = 50) -> Column:
    """Texts longer than ``width`` keep width - 3 characters and end in '...'."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)
