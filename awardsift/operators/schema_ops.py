"""Projections, renames and column sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (
    CONTRACT_COLUMNS, DESCRIPTION_COLUMNS, END_DATE_COLUMNS, ESSENTIAL_COLUMNS, GRANT_COLUMNS, REVIEW_COLUMNS, UNKNOWN,
)


def column_map(award_type: str) -> dict[str, str]:
    """Raw -> standard names; every type but contracts uses the grant names."""
    return CONTRACT_COLUMNS if award_type == "contracts" else GRANT_COLUMNS


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select([F.col(c) for c in columns if c in df.columns])


def map_columns(df: DataFrame, award_type: str) -> DataFrame:
    """Keep the raw columns of the type that exist, rename them and add the missing ones as null."""
    names = column_map(award_type)
    kept = keep_existing(df, list(names)).withColumnsRenamed(names)
    return ensure_columns(kept, {standard: T.StringType() for standard in names.values()})


def ensure_columns(df: DataFrame, wanted: T.StructType | dict[str, T.DataType | str]) -> DataFrame:
    """Add the columns that are missing as nulls; nothing else changes."""
    fields = {f.name: f.dataType for f in wanted.fields} if isinstance(wanted, T.StructType) else wanted
    missing = {name: F.lit(None).cast(kind) for name, kind in fields.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def align(labeled: DataFrame, unlabeled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to their common columns, in the labeled order.

    An essential column that only the labeled table has is kept there and is null in the other.
    """
    common = [c for c in labeled.columns if c in unlabeled.columns or c in ESSENTIAL_COLUMNS]
    kinds = {f.name: f.dataType for f in labeled.schema.fields if f.name in common}
    return labeled.select(common), ensure_columns(unlabeled, kinds).select(common)


def resolve_first(df: DataFrame, candidates: list[str], as_name: str) -> DataFrame:
    """First non-null of the candidate columns that exist; raises when none exists.

    Over a union of files with different columns this is the per-file fallback: a file that lacks a
    column has only nulls in it.
    """
    existing = [F.col(c) for c in candidates if c in df.columns]
    if not existing:
        raise ValueError(f"none of {candidates} is in {df.columns}")
    return df.withColumn(as_name, F.coalesce(*existing))


def end_date_fallback(df: DataFrame, as_name: str = END_DATE_COLUMNS[0]) -> DataFrame:
    return resolve_first(df, END_DATE_COLUMNS, as_name)


def description_fallback(df: DataFrame, as_name: str = DESCRIPTION_COLUMNS[0]) -> DataFrame:
    return resolve_first(df, DESCRIPTION_COLUMNS, as_name)


def fill_nulls(df: DataFrame) -> DataFrame:
    defaults = {"agency": UNKNOWN, "vendor": UNKNOWN, "clean_description": "", "normalized_value": 0.0}
    present = {name: value for name, value in defaults.items() if name in df.columns}
    return df.fillna(present) if present else df


def mark_canceled(df: DataFrame) -> DataFrame:
    return df.withColumn("is_canceled", F.lit(True))


def without(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns; absent ones are ignored."""
    return df.drop(*columns)


def _zero_filled(name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(name)


def numeric_features(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """The numeric feature columns that exist, null and NaN as 0, next to the ``keep`` columns."""
    return df.select(*keep, *[_zero_filled(c) for c in columns if c in df.columns])


def categorical_features(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """The categorical columns that exist; when none does, all of them as nulls."""
    present = [c for c in columns if c in df.columns]
    if not present:
        df, present = ensure_columns(df, {c: T.StringType() for c in columns}), columns
    return df.select(*keep, *present)


def review_projection(scored: DataFrame) -> DataFrame:
    """Rows for review with the columns of the review file that exist, in its order."""
    return keep_existing(scored.where("for_review"), REVIEW_COLUMNS)
