"""Column -> Column functions; all run inside the JVM."""

from .keywords import any_keyword, rows_with_keyword, keyword_pattern, main_keywords
from .names import dump_file_name, slug, standardize_name, vendor_or_unknown
from .numbers import hash01, money, normalize_value, percentage, run_stamp
from .text import clean_text, truncate, value_per_word, word_count

__all__ = [
    "any_keyword, rows_with_keyword", "clean_text", "dump_file_name", "hash01", "keyword_pattern", "main_keywords", "money",
    "normalize_value", "percentage", "run_stamp", "slug", "standardize_name", "truncate", "value_per_word",
    "vendor_or_unknown", "word_count",
]
