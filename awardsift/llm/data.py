"""Tables, stored intermediate results and the registry of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _checkpoint_folder, measure, ship_package
from ..session import store as _store

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}

#: Most bytes of text that one broadcast may hold; larger tables go in blocks or through a shuffle.
BLOCK_BYTES = 16 * 1024 * 1024

__all__ = ["BLOCK_BYTES", "LLM_ORACLES", "LLM_QUERIES", "folder", "measure", "only", "query", "ship_package", "store", "table"]


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back without lineage.

    The shuffle files behind the table are of no use once it is written and go at once, so that an operator of many
    steps needs the disk of its widest step only.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return _store(df)
    finally:
        conf.unset(_CLEAN) if before is None else conf.set(_CLEAN, before)


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""
    def register(function):
        LLM_QUERIES[function.__name__] = function
        if sql is not None:
            LLM_ORACLES[function.__name__] = sql
        return function
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that other columns of any name cannot clash with an operator's own."""
    return df.select(*[F.col(f"`{name}`") for name in names])


#: Words of a text in DuckDB, for the SQL of several queries.
SQL_SPACED = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"
SQL_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL_ALNUM = r"regexp_extract_all(" + SQL_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for an index or a result in the application's shared checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
