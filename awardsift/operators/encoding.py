"""Scaling and one-hot encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import UNKNOWN
from ..session import broadcast_if_small, checkpoint, measure
from .ranks import positions
from .vectors import as_vector, joined, single


def scaler_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and population standard deviation per column: (column, mean, std)."""
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns}
    row = df.agg(F.map_from_arrays(
        F.array(*[F.lit(c) for c in columns]),
        F.array(*[F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")) for x in filled.values()]),
    ).alias("m"))
    return row.select(F.explode("m").alias("column", "s")).select("column", "s.mean", "s.std")


def scaled(value: Column, mean: float, std: float) -> Column:
    """(value - mean) / std; a constant column is only centred."""
    filled = F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))
    return (filled - F.lit(float(mean))) / F.lit(float(std) if std else 1.0)


@dataclass
class CategorySlots:
    """The categories of one column, each with its slot in the one-hot vector, in alphabetical order."""

    column: str
    table: DataFrame                # category, slot
    size: tuple[int, int]           # rows, bytes
    unknown: int | None = None      # slot of 'Unknown', if it is one of the categories

    @property
    def slots(self) -> int:
        return self.size[0]

    @classmethod
    def learn(cls, column: str, categories: DataFrame, rows: int) -> CategorySlots:
        """Number the distinct categories, at most ``rows``; a long list is numbered by a distributed sort."""
        return cls.stored(column, checkpoint(positions(categories, "slot", F.col("category"), rows=rows)))

    @classmethod
    def stored(cls, column: str, table: DataFrame) -> CategorySlots:
        """Take a stored table of categories and slots as it is."""
        rows, volume, unknown = measure(table, slot=F.max(F.when(F.col("category") == UNKNOWN, F.col("slot"))))
        return cls(column, table, (rows, volume), unknown)

    def add_slot(self, df: DataFrame, name: Column, out: str, otherwise: int | None = None) -> DataFrame:
        """Slot of ``name``, else ``otherwise``, else null. Broadcast only within the measured bound."""
        table = broadcast_if_small(self.table, self.size).withColumnsRenamed({"category": "_category", "slot": out})
        joined = df.join(table, name == F.col("_category"), "left").drop("_category")
        return joined if otherwise is None else joined.withColumn(out, F.coalesce(out, F.lit(otherwise)))


def encoder_categories(df: DataFrame, columns: list[str]) -> list[CategorySlots]:
    """Slots for all distinct values of each column that exists; null counts as 'Unknown'."""
    parts = []
    for column in (c for c in columns if c in df.columns):
        distinct = checkpoint(df.select(F.coalesce(F.col(column), F.lit(UNKNOWN)).alias("category")).distinct())
        parts.append(CategorySlots.learn(column, distinct, distinct.count()))
    return parts


def one_hot(df: DataFrame, encoder: list[CategorySlots], unseen_as_unknown: bool = False, wrap: bool = True) -> DataFrame:
    """Add '<column>_vector' per encoded column; values the encoder has not seen give zeros, or count as 'Unknown'.

    ``wrap`` makes it a vector column; else it is the bare struct (see ``vectors``).
    """
    for part in encoder:
        slot = f"_{part.column}_slot"
        df = part.add_slot(df, F.coalesce(F.col(part.column), F.lit(UNKNOWN)), slot, part.unknown if unseen_as_unknown else None)
        own = single(F.col(slot), part.slots)
        df = df.withColumn(f"{part.column}_vector", as_vector(own) if wrap else own).drop(slot)
    return df


def encode_categories(df: DataFrame, columns: list[str] = ("agency", "vendor")) -> DataFrame:
    """One-hot vectors of a table's own categories in one call."""
    return one_hot(df, encoder_categories(df, list(columns)))


def scale_columns(train: DataFrame, test: DataFrame | None, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Replace the columns by their scaled values, with the statistics of ``train`` for both tables."""
    stats = {r["column"]: (r["mean"], r["std"]) for r in scaler_statistics(train, columns).collect()}
    values = {c: scaled(F.col(c), *stats[c]) for c in columns}
    return train.withColumns(values), None if test is None else test.withColumns(values)


def combine(df: DataFrame, columns: list[str], out: str = "features", wrap: bool = True) -> DataFrame:
    """One vector from number and vector columns of the same row, in the given order."""
    whole = joined(df, columns)
    return df.withColumn(out, as_vector(whole) if wrap else whole)
