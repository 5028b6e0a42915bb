"""Row filters."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import AWARD_TYPE_CODES, PLACEHOLDER_IDS, UNKNOWN
from ..functions import rows_with_keyword, vendor_or_unknown


def drop_placeholders(df: DataFrame) -> DataFrame:
    """Drop rows whose id is a placeholder; null ids stay."""
    if "piid" not in df.columns:
        return df
    return df.where(F.col("piid").isNull() | ~F.col("piid").isin(PLACEHOLDER_IDS))


def lenient_timestamp(text: Column) -> Column:
    """Timestamp, or null for texts that are no date: ISO first, then M/d/yyyy."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def is_active(kind: str, as_of: str | datetime.date, column: str = "end_date") -> Column:
    """Whether an award ends strictly after ``as_of``; ``kind`` is the column's type."""
    moment = lenient_timestamp(F.col(column)) if kind == "string" else F.col(column)
    return moment > F.lit(str(as_of)).cast("timestamp_ntz" if "ntz" in kind else "timestamp")


def active(df: DataFrame, as_of: str | datetime.date, column: str = "end_date") -> DataFrame:
    """Awards that end strictly after ``as_of``; texts that are no date are dropped."""
    return df.where(is_active(dict(df.dtypes)[column], as_of, column))


def keyword_match(df: DataFrame, column: str, words: list[str] | None, mode: str = "substring") -> DataFrame:
    """Rows with a keyword in the text; no list means no filter."""
    return df if words is None else rows_with_keyword(df, column, words, mode)


def department(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.contains(F.lower(F.col("agency")), F.lit(name.lower())))


def select_awards(
    df: DataFrame, award_type: str, agency: str, start: str, end: str,
    code: str = "award_type_code", agency_column: str = "agency", date: str = "action_date",
) -> DataFrame:
    """Awards of a type and agency with an action date in [start, end]."""
    return df.where(
        F.col(code).isin(AWARD_TYPE_CODES[award_type])
        & (F.col(agency_column) == agency)
        & F.col(date).cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )


def valid_vendor(vendor: Column) -> Column:
    """True for vendors that are named: neither null nor a placeholder."""
    return F.lower(vendor_or_unknown(vendor)) != UNKNOWN.lower()


def observed(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """The same rows plus a counter that is filled when an action runs over them.

    Put one before and one after a filter to log how many rows it removed, without another pass.
    """
    seen = Observation(step)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
