"""Zipped award dumps.

An archive is never read whole. One task per archive reads its directory, then one task per CSV member
streams that member in chunks, so a large archive is spread over as many tasks as it has members.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..constants import AWARD_TYPES
from ..operators.joins import add_acronym
from ..session import checkpoint, ship_package
from .paths import open_path

CHUNK_ROWS = 10_000
MAX_TASKS = 10_000
_TYPES = "|".join(AWARD_TYPES)


def list_archives(spark: SparkSession, path: str, pattern: str = "*.zip") -> DataFrame:
    """(path, file_name, length) of the archives; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    )


def dump_files(spark: SparkSession, path: str, department: str, award_type: str) -> DataFrame:
    """Archives of one department and award type: '<department slug>_<type>_*.zip'."""
    return list_archives(spark, path, f"{department.replace(' ', '_').lower()}_{award_type}_*.zip")


def department_of(file_name: Column) -> Column:
    """Department in lower case from a dump's file name; null when the name has no award type in it."""
    stem = F.regexp_extract(file_name, rf"^(.+?)_(?:{_TYPES})_", 1)
    return F.when(stem != "", F.lower(F.replace(stem, F.lit("_"), F.lit(" "))))


def award_type_of(file_name: Column) -> Column:
    kind = F.regexp_extract(file_name, rf"^.+?_({_TYPES})_", 1)
    return F.when(kind != "", kind)


def parse_dump_names(files: DataFrame, name: str = "file_name", names: DataFrame | None = None) -> DataFrame:
    """Add department, acronym and award_type; files that do not parse or name no department are dropped."""
    parsed = files.withColumns({"department": department_of(F.col(name)), "award_type": award_type_of(F.col(name))})
    return add_acronym(parsed.where(F.col("award_type").isNotNull()), "department", names)


def type_combos(parsed: DataFrame) -> DataFrame:
    """Distinct (department, acronym, award_type)."""
    return parsed.select("department", "acronym", "award_type").distinct()


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """CSV members of archives; an archive that cannot be read is a row with its error."""
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                with open_path(path) as stream, zipfile.ZipFile(stream) as archive:
                    rows += [(path, m.filename, m.file_size, None) for m in archive.infolist() if m.filename.endswith(".csv")]
            except zipfile.BadZipFile as error:
                rows.append((path, None, None, str(error)))
        yield pd.DataFrame(rows, columns=["path", "member", "member_size", "error"])


def _row_reader(columns: list[str]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_path(row["path"]) as stream, zipfile.ZipFile(stream) as archive, archive.open(row["member"]) as data:
                    yield from _chunks(data, row["path"], row["member"], columns)
    return read


def decoded(text: str) -> str:
    """A text read one byte per character: as UTF-8 if it is, else as it stands."""
    try:
        return text if text.isascii() else text.encode("latin1").decode()
    except UnicodeDecodeError:
        return text


def _decoded(values: pd.Series) -> pa.Array:
    """``decoded`` for a column: texts that are ASCII throughout are taken as they are."""
    texts = pa.array(values, pa.string(), from_pandas=True)
    if texts.null_count == len(texts) or pc.sum(pc.binary_length(texts)).as_py() == pc.sum(pc.utf8_length(texts)).as_py():
        return texts
    return pa.array([None if v is None else decoded(v) for v in texts.to_pylist()], pa.string())


def _chunks(data, path: str, member: str, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """A member is inflated once: its bytes are read one per character, and each value is decoded on its own.

    The first column is read in any case, so that a member with none of the columns still has its rows.
    """
    first: list[str] = []

    def wanted(name: str) -> bool:
        if not first:
            first.append(name)
        return name == first[0] or decoded(name).lstrip("\ufeff") in columns

    try:
        chunks = pd.read_csv(data, dtype=object, chunksize=CHUNK_ROWS, encoding="latin1", usecols=wanted)
    except pd.errors.EmptyDataError:
        return
    at = 0
    with chunks:
        for chunk in chunks:
            chunk.columns = [decoded(c).lstrip("\ufeff") for c in chunk.columns]
            n = len(chunk)
            texts = [_decoded(chunk[c]) if c in chunk else pa.nulls(n, pa.string()) for c in columns]
            place = [pa.repeat(path, n), pa.repeat(member, n), pa.array(np.arange(at, at + n))]
            at += n
            yield pa.RecordBatch.from_arrays([*place, *texts], ["path", "member", "row_no", *columns])


def archive_members(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, member, member_size, error): a stored table of all CSV members, and of archives that cannot be read."""
    ship_package(spark)
    return checkpoint(files.select("path").repartition("path").mapInPandas(
        _members, "path string, member string, member_size long, error string"))


def rejected_archives(members: DataFrame) -> DataFrame:
    """(path, error) of the archives that were left out."""
    return members.where("error IS NOT NULL").select("path", "error")


def select_dumps(parsed: DataFrame, departments: list[str] | None = None, award_types: list[str] | None = None) -> DataFrame:
    """Archives of the named departments and award types, before anything in them is read; no list means all."""
    if departments is not None:
        parsed = parsed.where(F.lower("department").isin([d.lower() for d in departments]))
    return parsed if award_types is None else parsed.where(F.col("award_type").isin(award_types))


def read_zipped_csv(spark: SparkSession, files: DataFrame, columns: T.StructType = schema.RAW_DUMP, members: DataFrame | None = None) -> DataFrame:
    """Rows of all CSV members, at any depth, of the listed archives (or of ``archive_members``, if given).

    Columns: path, member, row_no (position in the member), file_name and the wanted columns as text, null where a
    member lacks them. Archives that cannot be read are in ``rejected_archives``.
    """
    members = archive_members(spark, files) if members is None else members
    readable = members.where("error IS NULL").drop("error")
    shape = T.StructType([
        T.StructField("path", T.StringType()), T.StructField("member", T.StringType()), T.StructField("row_no", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in columns.names],
    ])
    spread = readable.repartition(min(max(readable.count(), 1), MAX_TASKS))
    rows = spread.mapInArrow(_row_reader(columns.names), shape)
    return rows.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
