"""Preparation of labeled and unlabeled awards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, normalize_value, value_per_word
from ..operators.joins import exclude_labeled
from ..operators.schema_ops import ensure_columns, fill_nulls, mark_canceled


def _derive(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    derived = {}
    if "description" in kinds:
        text = F.col("description") if kinds["description"] == "string" else F.lit(None).cast("string")
        derived["clean_description"] = clean_text(text)
    if "value" in kinds:
        derived["normalized_value"] = normalize_value(F.col("value"), kinds["value"])
    df = fill_nulls(df.withColumns(derived) if derived else df)
    if {"clean_description", "normalized_value"} <= set(df.columns):
        df = df.withColumn("value_per_word", value_per_word(F.col("normalized_value"), F.col("clean_description")))
    return df


def prepare_labeled(df: DataFrame) -> DataFrame:
    """Clean text, amount, fills, value per word and the constant ``is_canceled``."""
    return mark_canceled(_derive(df))


def prepare_unlabeled(
    df: DataFrame, ids: DataFrame | None = None, ids_size: tuple[int, int] | None = None,
    required: dict[str, str] | None = None,
) -> DataFrame:
    """The same for awards to score, without those that are labeled.

    The labeled ones go first, so their text is never cleaned.
    """
    if ids is not None:
        df = exclude_labeled(df, ids, ids_size)
    wanted = required or {"normalized_value": "double", "agency": "string", "vendor": "string"}
    return ensure_columns(_derive(df), wanted)
