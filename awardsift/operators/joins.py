"""Joins."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEPARTMENTS
from ..session import broadcast_if_small


def distinct_ids(df: DataFrame, column: str = "piid") -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct()


def exclude_labeled(df: DataFrame, ids: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Awards whose id is not among ``ids``; null ids stay.

    ``size`` is the measured (rows, bytes) of ``ids``. Inside the broadcast bound the award table is
    not shuffled at all; beyond it, or unmeasured, the join is left to AQE, which splits hot ids.
    """
    if "piid" not in df.columns:
        return df
    return df.join(broadcast_if_small(ids, size) if size else ids, "piid", "left_anti")


def departments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEPARTMENTS.items()), "department string, acronym string")


def add_acronym(df: DataFrame, column: str = "department", names: DataFrame | None = None) -> DataFrame:
    """Acronym and canonical spelling per department, letter case ignored; unknown names are dropped.

    The default list has 21 rows and is broadcast; a list of the caller's is left to AQE.
    """
    known = F.broadcast(departments(df.sparkSession)) if names is None else names
    known = known.withColumnsRenamed({"department": "_name"})
    joined = df.join(known, F.lower(F.col(column)) == F.lower("_name"))
    return joined.withColumn(column, F.col("_name")).drop("_name")


def missing_files(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected file names that were not found."""
    return expected.join(found.select("file_name").distinct(), "file_name", "left_anti")


def _add_months(day: datetime.date, months: int) -> datetime.date:
    year, month = divmod(day.year * 12 + day.month - 1 + months, 12)
    last = (datetime.date(year + (month == 11), (month + 1) % 12 + 1, 1) - datetime.timedelta(days=1)).day
    return datetime.date(year, month + 1, min(day.day, last))


def date_ranges(spark: SparkSession, start: str, end: str, months: int = 3) -> DataFrame:
    """Consecutive ranges of ``months`` months, the last one cut at ``end``.

    Each range starts the day after the one before ends, so month-end starts drift (31 Jan, 30 Apr,
    30 Jul); a remainder of one day is left out. A century of quarters is 400 rows.
    """
    day, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    rows = []
    while day < last:
        until = min(_add_months(day, months) - datetime.timedelta(days=1), last)
        rows.append((day, until))
        day = until + datetime.timedelta(days=1)
    return spark.createDataFrame(rows, "range_start date, range_end date")


def assign_range(df: DataFrame, start: str, end: str, column: str, months: int = 3) -> DataFrame:
    """Rows with a date inside [start, end], each with the range it falls in.

    The ranges follow each other without gaps, so the start of a date's range is found by looking it
    up in the short sorted list carried as a literal; rows are neither joined nor shuffled.
    """
    spark = df.sparkSession
    ranges = [tuple(row) for row in date_ranges(spark, start, end, months).collect()]
    if not ranges:
        return df.withColumns({"range_start": F.lit(None).cast("date"), "range_end": F.lit(None).cast("date")}).limit(0)
    bounds = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ranges])
    day = F.col(column).cast("date")
    inside = df.where(day.between(F.lit(ranges[0][0]), F.lit(ranges[-1][1])))
    hit = F.element_at(F.filter(bounds, lambda r: day.between(r["a"], r["b"])), 1)
    return inside.withColumns({"range_start": hit["a"], "range_end": hit["b"]})
