"""Fused features: text vector, scaled numbers and one-hot categories of the frequent names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNKNOWN
from ..functions import standardize_name, vendor_or_unknown
from .aggregates import top_categories
from .encoding import CategorySlots, combine, one_hot, scaled, scaler_statistics

NUMERIC_COLUMNS = ["normalized_value"]
CATEGORICAL_COLUMNS = ["agency", "vendor"]


def category_name(column: str, source: str | None = None) -> Column:
    """Standardised name of a category column, read from ``source`` if it was renamed.

    Null and placeholder names become 'Unknown' or 'unknown'.
    """
    raw = F.col(source or column)
    return standardize_name(vendor_or_unknown(raw) if column == "vendor" else F.coalesce(raw, F.lit(UNKNOWN)))


def name_counts(df: DataFrame, column: str, literal_unknown: bool = False) -> DataFrame:
    """Rows per standardised name, unknown names left out.

    Spellings are counted first, so the name rules run once per spelling and not once per row.
    ``literal_unknown`` leaves out only the exact text 'Unknown', so a name standardised to 'unknown'
    competes for a place in the top list.
    """
    raw = vendor_or_unknown(F.col(column)) if column == "vendor" else F.coalesce(F.col(column), F.lit(UNKNOWN))
    counts = df.groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    if column == "vendor":
        counts = counts.where(F.col("raw") != UNKNOWN if literal_unknown else F.lower("raw") != UNKNOWN.lower())
    named = counts.select(standardize_name(F.col("raw")).alias("category"), "n")
    summed = named.groupBy("category").agg(F.sum("n").alias("n"))
    return summed.where(F.col("category") != UNKNOWN if literal_unknown else F.lower("category") != UNKNOWN.lower())


@dataclass
class FusionModel:
    """What a fit learns: statistics per number, slots per category column."""

    numeric: list[tuple[str, float, float]] = field(default_factory=list)   # column, mean, std
    categories: list[CategorySlots] = field(default_factory=list)
    share: float = 0.2

    @classmethod
    def fit(
        cls, df: DataFrame, share: float = 0.2, numeric: list[str] = NUMERIC_COLUMNS,
        categorical: list[str] = CATEGORICAL_COLUMNS, literal_unknown: bool = False,
    ) -> FusionModel:
        """Learn from a stored or persisted table; it is read once per column."""
        numeric = [c for c in numeric if c in df.columns]
        stats = {r["column"]: r for r in scaler_statistics(df, numeric).collect()} if numeric else {}
        model = cls(numeric=[(c, stats[c]["mean"] or 0.0, stats[c]["std"] or 0.0) for c in numeric], share=share)
        total = df.count()
        for column in (c for c in categorical if c in df.columns):
            top, rows = top_categories(name_counts(df, column, literal_unknown), share)
            # Rows that no top name covers make 'Unknown' a category of its own.
            rest = top.agg((F.lit(total) - F.coalesce(F.sum("n"), F.lit(0))).alias("rest")).where("rest > 0")
            names = top.select("category").union(rest.select(F.lit(UNKNOWN)))
            model.categories.append(CategorySlots.learn(column, names, rows + 1))
        return model

    def map_categories(self, df: DataFrame) -> DataFrame:
        """Each category column as the name the encoder knows it by: a top name or 'Unknown'."""
        for part in self.categories:
            slot = f"_{part.column}_slot"
            named = df.withColumn(part.column, category_name(part.column))
            df = part.add_slot(named, F.col(part.column), slot)
            df = df.withColumn(part.column, F.when(F.col(slot).isNotNull(), F.col(part.column)).otherwise(UNKNOWN)).drop(slot)
        return df

    def transform(self, df: DataFrame, text: str | None = "text_vector", out: str = "features", wrap: bool = True) -> DataFrame:
        """Add the fused vector, or its bare struct without ``wrap``; all other columns stay as they are."""
        parts = [text] if text and text in df.columns else []
        for name, mean, std in self.numeric:
            if name in df.columns:
                df = df.withColumn(f"num_{name}", scaled(F.col(name), mean, std))
                parts.append(f"num_{name}")
        present = [c for c in self.categories if c.column in df.columns and c.slots]
        original = {c.column: f"_raw_{c.column}" for c in present}
        df = df.withColumnsRenamed(original).withColumns({c: category_name(c, raw) for c, raw in original.items()})
        df = one_hot(df, present, unseen_as_unknown=True, wrap=False)
        parts += [f"{c.column}_vector" for c in present]
        if not parts:
            raise ValueError("the model has no features: fit it on a table with feature columns")
        df = df.drop(*original).withColumnsRenamed({raw: c for c, raw in original.items()})
        extra = [p for p in parts if p != text]
        return combine(df, parts, out, wrap).drop(*extra)

    def fit_transform(self, df: DataFrame, text: str | None = "text_vector") -> DataFrame:
        fitted = FusionModel.fit(df, self.share)
        self.numeric, self.categories = fitted.numeric, fitted.categories
        return self.transform(df, text)

    def size(self, text_size: int) -> int:
        return text_size + len(self.numeric) + sum(c.slots for c in self.categories)

    def feature_names(self, spark, text_size: int) -> DataFrame:
        """(feature, name) in vector order: text_<i>, num_<column>, <column>_<category>."""
        names = spark.range(text_size).select(F.col("id").cast("int").alias("feature"), F.concat(F.lit("text_"), "id").alias("name"))
        at = text_size
        for name, _, _ in self.numeric:
            names = names.union(spark.createDataFrame([(at, f"num_{name}")], "feature int, name string"))
            at += 1
        for part in self.categories:
            names = names.union(part.table.select(
                (F.col("slot") + at).cast("int").alias("feature"), F.concat(F.lit(f"{part.column}_"), "category").alias("name")
            ))
            at += part.slots
        return names

