"""JSON and CSV award files."""

from __future__ import annotations

import csv
import io
import json
import logging
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..constants import NULL_TEXTS
from ..operators.aggregates import page_cutoff
from ..operators.filters import drop_placeholders
from ..operators.ranks import exact_sample
from ..session import ship_package
from .paths import open_path

log = logging.getLogger(__name__)
_STRUCTURE = re.compile(rb'\\.|["{}\[\]]', re.S)


def _as_list(paths: str | list[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def read_json_awards(
    spark: SparkSession, paths: str | list[str], fields: T.StructType = schema.LABELED, multi_line: bool | None = None, strict: bool = False,
) -> DataFrame:
    """Awards from JSON: ``{"data": [...]}``, a bare array, or one object per line.

    An envelope is a value whose ``data`` is set; every other one is an award itself. Without ``multi_line`` each file is
    looked at: if its first line is a whole JSON value, every line is one; else the file is one value over several lines
    or, where it holds no such value, is read by lines all the same. A file that is one value is one task of at most 2 GB, so large
    inputs should come as JSON lines. What is no JSON is left out and is in ``rejected_json``, or raises when ``strict``; a second
    value in a file that should hold one always raises.
    """
    files = _json_files(spark, _as_list(paths)) if multi_line is None else [(p, not multi_line) for p in _as_list(paths)]
    frames = []
    if lines := [p for p, by_line in files if by_line]:
        frames.append(_json_lines(spark, lines, fields, strict))
    if whole := [p for p, by_line in files if not by_line]:
        frames.append(_json_values(spark, whole, fields, strict))
    return _union(spark, frames, fields)


def rejected_json(
    spark: SparkSession, paths: str | list[str], fields: T.StructType = schema.LABELED, multi_line: bool | None = None,
) -> DataFrame:
    """(path, line, error) of the lines and files that ``read_json_awards`` leaves out; ``line`` is null for a whole file."""
    files = _json_files(spark, _as_list(paths)) if multi_line is None else [(p, not multi_line) for p in _as_list(paths)]
    frames = []
    if lines := [p for p, by_line in files if by_line]:
        raw = _raw_lines(spark, lines, fields).withColumn("path", F.col("_metadata.file_path"))
        frames.append(raw.where(_no_json(fields)).select("path", F.col("_bad").alias("line"), F.lit("no JSON").alias("error")))
    if whole := [p for p, by_line in files if not by_line]:
        texts = _texts(spark, whole).withColumn("path", F.col("_metadata.file_path"))
        why = F.when(F.col("values") == 0, "no JSON").when(F.col("values") == 1, "no award").otherwise("more than one JSON value")
        lost = texts.where((F.col("values") != 1) | _parsed(fields).isNull())
        frames.append(lost.select("path", F.lit(None).cast("string").alias("line"), why.alias("error")))
    return _union(spark, frames, T.StructType([T.StructField(c, T.StringType()) for c in ("path", "line", "error")]))


def _envelope(fields: T.StructType) -> T.StructType:
    return T.StructType([*fields.fields, T.StructField("data", T.ArrayType(fields), True)])


def _raw_lines(spark: SparkSession, paths: list[str], fields: T.StructType) -> DataFrame:
    shape = T.StructType([*_envelope(fields).fields, T.StructField("_bad", T.StringType(), True)])
    return spark.read.schema(shape).json(paths, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")


def _no_json(fields: T.StructType) -> Column:
    # A value of another type only empties its field; a row that is no JSON has nothing but the bad text, or the fields before its cut.
    nothing = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in ("data", *fields.names)])
    cut = F.get_json_object(F.regexp_replace("_bad", "^\uFEFF", F.lit("")), "$").isNull()
    return F.col("_bad").isNotNull() & (nothing | cut)


def _json_lines(spark: SparkSession, paths: list[str], fields: T.StructType, strict: bool) -> DataFrame:
    return _awards(_raw_lines(spark, paths, fields).where(_good(~_no_json(fields), strict)), fields)


def _good(good: Column, strict: bool) -> Column:
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit("not a JSON award file")).cast("boolean")) if strict else good


def _awards(raw: DataFrame, fields: T.StructType) -> DataFrame:
    itself = F.array(F.struct(*fields.names))
    return raw.select(F.explode(F.coalesce("data", itself)).alias("award")).select("award.*")


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    ship_package(spark)
    return spark.read.text(paths, wholetext=True).withColumn("values", json_values(F.col("value")))


def _parsed(fields: T.StructType) -> Column:
    return F.from_json(F.regexp_replace("value", "^\uFEFF", F.lit("")), T.ArrayType(_envelope(fields)))


def _json_values(spark: SparkSession, paths: list[str], fields: T.StructType, strict: bool) -> DataFrame:
    """Files that are one value each; an array's elements are taken like values of their own."""
    texts = _texts(spark, paths)
    one = F.when(F.col("values") > 1, F.raise_error(F.lit("more than one JSON value in a file")).cast("boolean")).otherwise(F.col("values") == 1)
    good = texts.where(_good(one, strict))
    parsed = good.select(F.explode(_parsed(fields)).alias("v")).select("v.*")
    return _awards(parsed, fields)


@F.arrow_udf(T.IntegerType())
def json_values(texts: pa.Array) -> pa.Array:
    """Number of JSON values in a text: 0 if it is no JSON, 2 if there is something after the first one."""
    counts = []
    for text in texts:
        text = (text.as_py() or "").lstrip("\ufeff \t\r\n")
        try:
            counts.append(1 if not text[json.JSONDecoder().raw_decode(text)[1]:].strip() else 2)
        except ValueError:
            counts.append(0)
    return pa.array(counts, pa.int32())


def _json_files(spark: SparkSession, paths: list[str]) -> list[tuple[str, bool]]:
    """Files under the paths and whether each of their lines is a value; workers read past the first line only if that is none."""
    ship_package(spark)

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(path, is_by_line(path)) for path in batch["p"]], columns=["p", "by_line"])

    found = _listing(spark, paths, None).select("p").where(~F.element_at(F.split("p", "/"), -1).rlike("^[_.]"))
    return sorted(map(tuple, found.mapInPandas(look, "p string, by_line boolean").collect()))


def is_by_line(path: str, most: int = 1 << 26) -> bool:
    """Whether a file is to be read by lines: its first line that is not blank is a whole JSON value, or it isn't one value over several lines.

    A line beyond ``most`` bytes counts as a value if its brackets close in it. Beyond 2 GB a file whose first line is no value is
    taken for one value, which Spark refuses to read.
    """
    with open_path(path) as stream:
        line = b""
        while not line.strip(b"\xef\xbb\xbf \t\r\n"):
            line = stream.readline(most)
            if not line:
                return True  # nothing but blanks: no rows either way
        if len(line) >= most and not line.endswith(b"\n"):
            if _closes(line, stream, most):
                return True
        else:
            try:
                json.loads(line.decode("utf-8-sig", errors="replace"))
                return True
            except ValueError:
                pass
        if stream.seek(0, io.SEEK_END) >= 1 << 31:
            return False
        stream.seek(0)
        text = stream.read().decode("utf-8-sig", errors="replace").lstrip("\ufeff \t\r\n")
    try:
        end = json.JSONDecoder().raw_decode(text)[1]
    except ValueError:
        return True
    return "\n" not in text[:end] and bool(text[end:].strip())  # a first line with a value and something after it


def _closes(piece: bytes, stream: io.BufferedIOBase, most: int) -> bool:
    """Whether all brackets and strings of a line, of which ``piece`` is the beginning, are closed in it."""
    depth, inside = 0, False
    while piece:
        ended = piece.endswith(b"\n")
        if not ended and (len(piece) - len(piece.rstrip(b"\\"))) % 2:
            piece += stream.readline(1)  # an escape is not cut
        for found in _STRUCTURE.finditer(piece):
            mark = found[0]
            if mark == b'"':
                inside = not inside
            elif not inside and len(mark) == 1:
                depth += 1 if mark in b"{[" else -1
        piece = b"" if ended else stream.readline(most)
    return depth == 0 and not inside


def read_labeled(spark: SparkSession, path: str, fields: T.StructType = schema.LABELED, multi_line: bool | None = None) -> DataFrame:
    """Labeled awards without placeholder ids. A missing path or a file that is no JSON raises."""
    return drop_placeholders(read_json_awards(spark, path, fields, multi_line, strict=True))


def read_csv_awards(
    spark: SparkSession, paths: str | list[str], fields: T.StructType = schema.AWARD, multi_line: bool = True, encoding: str | None = None,
) -> DataFrame:
    """CSV files with a header, matched by column name.

    Without ``encoding``, each value is taken as UTF-8 if its bytes are, else as latin1: the bytes are read once, one
    character each, and decoded per value. Files are grouped by header, since Spark takes one header per read.
    Columns that are no text are cast after decoding. Texts that mean "no value" are null.
    """
    files = sorted(row["p"] for row in _listing(spark, _as_list(paths), "*.csv").collect())
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in _headers(spark, files):
        groups.setdefault(header, []).append(path)
    frames = []
    for header, members in sorted(groups.items()):
        kinds = {f.name: f.dataType for f in fields.fields}
        read = spark.read.schema(T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(len(header))])).csv(
            members, header=True, enforceSchema=True, multiLine=multi_line, quote='"', escape='"', encoding=encoding or "ISO-8859-1",
            mode="PERMISSIVE", ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False,
        )
        texts = [F.col(f"c{i}") if encoding else _decoded(F.col(f"c{i}")) for i in range(len(header))]
        named = [F.when(~text.isin(NULL_TEXTS), text).cast(kinds.get(name, T.StringType())).alias(name) for name, text in zip(header, texts)]
        frames.append(read.select(*named))
    return _union(spark, frames, fields)


def _decoded(text: Column) -> Column:
    """A text read one byte per character: as UTF-8 if it is, else as it stands. Plain ASCII, nearly all, is left alone."""
    raw = F.encode(text, "ISO-8859-1").cast("string")
    return F.when(text.rlike(r"[^\x00-\x7F]") & F.is_valid_utf8(raw), raw).otherwise(text)


def _headers(spark: SparkSession, files: list[str]) -> list[tuple[str, tuple[str, ...]]]:
    """Column names per file. Workers read no further than the header row."""
    if not files:
        return []

    def first_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path in batch["p"]:
                with open_path(path) as stream:
                    text = io.TextIOWrapper(stream, encoding="utf-8-sig", errors="replace", newline="")
                    found.append((path, next(csv.reader(text), [])))
            yield pd.DataFrame(found, columns=["p", "header"])

    ship_package(spark)
    listed = spark.createDataFrame([(p,) for p in files], "p string").repartition(max(1, min(len(files), 1000)))
    return [(r["p"], tuple(r["header"])) for r in listed.mapInPandas(first_rows, "p string, header array<string>").collect()]


def _union(spark: SparkSession, frames: list[DataFrame], fields: T.StructType) -> DataFrame:
    """Rows of all frames with the union of their columns; without frames, an empty table."""
    if not frames:
        return spark.createDataFrame([], fields)
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    return whole


def _listing(spark: SparkSession, paths: list[str], pattern: str | None, deep: bool = False) -> DataFrame:
    """Paths and modification times of the files under ``paths`` that match; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", deep)
    return (
        (reader.option("pathGlobFilter", pattern) if pattern else reader).load(paths)
        .select(F.col("path").alias("p"), "modificationTime", "length")
    )


def read_awards(
    spark: SparkSession, paths: str | list[str], sample_size: int | None = None, seed: int = 42,
    fields: T.StructType = schema.AWARD, key: str | list[str] = ("piid", "description"),
) -> DataFrame:
    """Awards from a directory (its CSV and JSON files), one file or a list; other files are skipped.

    Files are unioned by column name; a path that cannot be read is skipped with a warning, and JSON lines and files that
    are no JSON are in ``rejected_awards``. Sampling,
    if asked for, takes exactly ``sample_size`` rows of the union.
    """
    csv_paths, json_paths = _award_files(spark, paths)
    frames = []
    for group, reader in ((csv_paths, read_csv_awards), (json_paths, read_json_awards)):
        if group:
            frames.append(reader(spark, group, fields=fields))
    whole = _union(spark, frames, fields)
    return whole if sample_size is None else sampled(whole, sample_size, seed, key)


def rejected_awards(spark: SparkSession, paths: str | list[str], fields: T.StructType = schema.AWARD) -> DataFrame:
    """(path, line, error) of the JSON lines and files that ``read_awards`` leaves out."""
    return rejected_json(spark, _award_files(spark, paths)[1], fields)


def _award_files(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[str]]:
    """The CSV and the JSON files under the paths."""
    csv_paths, json_paths = [], []
    for path in _as_list(paths):
        lower = path.lower()
        if lower.endswith((".csv", ".json")):
            if _exists(spark, path):  # paths that the caller names; listed files are there
                (csv_paths if lower.endswith(".csv") else json_paths).append(path)
            continue
        try:
            found = [row["p"] for row in _listing(spark, [path], "*.{csv,json,CSV,JSON}").select("p").collect()]
        except (AnalysisException, Py4JJavaError):
            found = []
        if not found:
            log.warning("no CSV or JSON files in %s", path)
        csv_paths += sorted(p for p in found if p.lower().endswith(".csv"))
        json_paths += sorted(p for p in found if p.lower().endswith(".json"))
    return csv_paths, json_paths


def sampled(awards: DataFrame, size: int, seed: int = 42, key: str | list[str] = ("piid", "description")) -> DataFrame:
    """Exactly ``size`` awards, all of them if there are fewer."""
    keys = [k for k in ([key] if isinstance(key, str) else key) if k in awards.columns] or awards.columns
    return exact_sample(awards, size, keys, seed)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.format("binaryFile").load(path).select("path").limit(1)
        return True
    except AnalysisException:
        log.warning("cannot read %s, skipped", path)
        return False


def latest_snapshot(spark: SparkSession, directory: str) -> str | None:
    """Path of the newest ``*.json`` in a directory, a file or a folder of files (see ``write_snapshot``); None when there is none."""
    name = F.split("p", "/")
    inside = F.element_at(name, -2).rlike(r"\.json$")
    whole = F.when(inside, F.regexp_replace("p", "/[^/]+$", "")).otherwise(F.col("p"))
    here = F.element_at(F.split(whole, "/"), -2) == directory.rstrip("/").rsplit("/", 1)[-1]
    try:
        found = _listing(spark, [directory], "*.json", deep=True).where(here)
        newest = found.agg(F.max_by(whole, F.struct("modificationTime", "p")).alias("p")).first()
    except AnalysisException:
        return None
    return newest["p"]


def read_paged(spark: SparkSession, paths: str | list[str], key: str, max_pages: int, fields: T.StructType = schema.LABELED) -> DataFrame:
    """Records of landed API pages, cut where the download would have stopped.

    A page file holds ``{"success", "result": {key: [...]}, "meta": {"pages"}}``; its number is the last
    number in its name.
    """
    shape = T.StructType([
        T.StructField("success", T.BooleanType()),
        T.StructField("result", T.StructType([T.StructField(key, T.ArrayType(fields))])),
        T.StructField("meta", T.StructType([T.StructField("pages", T.IntegerType())])),
    ])
    pages = spark.read.schema(shape).json(_as_list(paths), multiLine=True).select(
        F.regexp_extract("_metadata.file_name", r"(\d+)\D*$", 1).cast("int").alias("page"),
        F.col(f"result.{key}").alias("items"), F.col("meta.pages").alias("pages"),
    )
    kept = page_cutoff(pages.withColumn("n_items", F.size("items")), max_pages)
    return kept.select("page", F.explode("items").alias("item")).select("page", "item.*")
