"""Agency, vendor and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PLACEHOLDER_VENDORS, UNKNOWN

_SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def standardize_name(name: Column) -> Column:
    """Lower case, no '.' or ',', one trailing company suffix removed, single spaces.

    The suffix is looked for before the blanks at the end are trimmed, so 'acme inc ' keeps it, and
    only one goes: 'acme co llc' becomes 'acme co'. Null and empty names give 'Unknown'.
    """
    bare = F.translate(F.lower(name), ".,", "")
    short = F.regexp_replace(bare, rf"(?d){_SPACE}+(?:inc|llc|ngo|co)$", "")
    tidy = F.trim(F.regexp_replace(short, f"{_SPACE}+", " "))
    return F.coalesce(F.nullif(tidy, F.lit("")), F.lit(UNKNOWN))  # nullif evaluates the name once


def vendor_or_unknown(vendor: Column) -> Column:
    """Placeholder vendors and null become 'Unknown'."""
    return F.when(vendor.isNull() | vendor.isin(PLACEHOLDER_VENDORS), F.lit(UNKNOWN)).otherwise(vendor)


def slug(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def dump_file_name(department: Column, award_type: Column, start: Column, end: Column) -> Column:
    """'<department slug>_<type>_<start>_to_<end>.zip'."""
    return F.concat(slug(department), F.lit("_"), award_type, F.lit("_"), start, F.lit("_to_"), end, F.lit(".zip"))
