"""Sinks with a commit in two phases.

``award_table``: tasks write Parquet files under names that nobody reads yet and report them in their commit messages;
when all have, the driver writes the next manifest, one small file that lists what the table consists of. A manifest
appears whole or not at all, so readers see the table before or after a run, never in between, whatever tasks were killed,
repeated or run twice; files that no manifest lists are nothing. The summary of a run comes from the messages.

``award_archives``: zipped CSV dumps, one a task, department and award type, written aside and moved into the folder on
commit; each appears whole.
"""

from __future__ import annotations

import csv
import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.aggregates import by_score
from .operators.schema_ops import review_projection
from .session import ship_package
from .sources.paths import files_in, locate, plain_address, read_json, write_new

TABLE, ARCHIVES = "award_table", "award_archives"
#: Files that a task holds open at once; beyond them the one used longest ago is closed, and a value that comes back opens another.
OPEN = 64
COMMITS = 20


@dataclass
class File:
    """A finished file: where it is, the place of its task, its values in the partition columns, and its size."""

    path: str
    part: int
    values: list
    rows: int
    bytes: int


@dataclass
class Files(D.WriterCommitMessage):
    files: list[File]


class _Parquet:
    def __init__(self, system: fs.FileSystem, path: str, schema: pa.Schema):
        self.out = system.open_output_stream(path)
        self.writer, self.rows = pq.ParquetWriter(self.out, schema), 0

    def add(self, rows: pa.Table) -> None:
        self.writer.write_table(rows)
        self.rows += rows.num_rows

    def close(self) -> None:
        self.writer.close()
        self.out.close()


class _Zip:
    def __init__(self, system: fs.FileSystem, path: str, schema: pa.Schema):
        self.out = system.open_output_stream(path)
        self.archive = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.member = io.TextIOWrapper(self.archive.open(path.rsplit("/", 1)[-1].replace(".zip", ".csv"), "w"), "utf-8", newline="")
        self.writer, self.rows = csv.writer(self.member), 0
        self.writer.writerow(schema.names)

    def add(self, rows: pa.Table) -> None:
        self.writer.writerows(zip(*(c.to_pylist() for c in rows.columns)))
        self.rows += rows.num_rows

    def close(self) -> None:
        self.member.close()
        self.archive.close()
        self.out.close()


def by_values(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each combination of values."""
    table = pa.Table.from_batches([batch])
    if not columns or not table.num_rows:
        yield (), table
        return
    # one number for each combination, in the order of first rows: values are looked at once each, not row by row
    code = np.zeros(table.num_rows, np.int64)
    for c in columns:
        coded = batch.column(c).dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    values = table.select(columns).take(pa.array(first)).to_pylist()
    order = np.argsort(code, kind="stable")
    stops = np.cumsum(np.bincount(code))
    for k in np.argsort(first, kind="stable"):
        yield tuple(values[k][c] for c in columns), table.take(pa.array(order[stops[k - 1] if k else 0:stops[k]]))


class _Writer(D.DataSourceArrowWriter):
    """Files of one task, by the values of some columns; ``place`` names a file within the run's own folder."""

    def __init__(self, root: str, columns: list[str], opener, inner: list[str] | None = None):
        self.root, self.columns, self.opener, self.inner = root, columns, opener, inner

    def place(self, values: tuple, part: int, attempt: int, number: int) -> str:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        system, root = locate(self.root)
        opened: dict[tuple, tuple[str, object]] = {}
        done: list[File] = []

        def close(values: tuple) -> None:
            path, file = opened.pop(values)
            file.close()
            done.append(File(path, part, [None if v is None else str(v) for v in values], file.rows, system.get_file_info(path).size))

        try:
            for batch in iterator:
                for values, rows in by_values(batch, self.columns):
                    rows = rows if self.inner is None else rows.select(self.inner)
                    if values in opened:
                        opened[values] = opened.pop(values)  # used last
                    else:
                        if len(opened) >= OPEN:
                            close(next(iter(opened)))
                        path = f"{root}/{self.place(values, part, attempt, len(done) + len(opened))}"
                        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        opened[values] = path, self.opener(system, path, rows.schema)
                    opened[values][1].add(rows)
            while opened:
                close(next(iter(opened)))
        except BaseException:
            _remove(system, [*(f.path for f in done), *(path for path, _ in opened.values())])
            raise
        return Files(done)

    @staticmethod
    def listed(messages: list[Files | None]) -> list[File]:
        return sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (f.part, f.path))

    def abort(self, messages: list[Files | None]) -> None:
        _remove(locate(self.root)[0], [f.path for f in self.listed(messages)])


def _remove(system: fs.FileSystem, paths: list[str]) -> None:
    """Delete files of a run that failed; one that is not there is no error."""
    for path in paths:
        if system.get_file_info(path).type == fs.FileType.File:
            system.delete_file(path)


class _TableWriter(_Writer):
    def __init__(self, root: str, schema: T.StructType, overwrite: bool, columns: list[str], run: str):
        super().__init__(root, columns, _Parquet)
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema]).json()  # any column may hold nulls in another run
        self.overwrite, self.run, self.job = overwrite, run, uuid.uuid4().hex

    def place(self, values: tuple, part: int, attempt: int, number: int) -> str:
        folders = "".join(f"{c}={quote(str(v), safe='')}/" for c, v in zip(self.columns, values))
        return f"data/{self.job}/{folders}part-{part:06d}-{attempt}-{number}.parquet"

    def commit(self, messages: list[Files | None]) -> None:
        files = [asdict(f) for f in self.listed(messages)]
        for _ in range(COMMITS):
            last = latest(self.root)
            before = [] if last is None or self.overwrite else last["files"]
            version = 1 if last is None else last["version"] + 1
            if before and last["schema"] != self.schema:
                raise ValueError("the rows do not have the columns of the table")
            try:
                write_new(f"{self.root}/manifests", f"v{version:012d}.json", {
                    "version": version, "run": self.run, "schema": self.schema, "columns": self.columns, "files": before + files, "new": len(files)})
                return
            except FileExistsError:
                continue  # another run was faster; its files count as before
        raise RuntimeError(f"{COMMITS} other runs were faster")


class AwardTable(D.DataSource):
    """Writer only. Options: ``path``, ``partitions`` (columns, separated by commas), ``run`` (a name for the run)."""

    @classmethod
    def name(cls) -> str:
        return TABLE

    def writer(self, schema: T.StructType, overwrite: bool) -> _TableWriter:
        columns = [c for c in self.options.get("partitions", "").split(",") if c]
        return _TableWriter(self.options["path"], schema, overwrite, columns, self.options.get("run", ""))


_NAMED = ["department", "award_type", "period_from", "period_to"]


class _ArchiveWriter(_Writer):
    def __init__(self, root: str, schema: T.StructType):
        missing = [c for c in _NAMED if c not in schema.names]
        if missing:
            raise ValueError(f"archives are named after columns {missing}")
        super().__init__(root, _NAMED, _Zip, [c for c in schema.names if c not in _NAMED])
        self.job = uuid.uuid4().hex

    def place(self, values: tuple, part: int, attempt: int, number: int) -> str:
        department, kind, start, end = values
        return f"_staged/{self.job}/{department.replace(' ', '_').lower()}_{kind}_{start}_to_{end}_{self.job[:8]}_{part}_{number}.zip"

    def commit(self, messages: list[Files | None]) -> None:
        system, root = locate(self.root)
        for file in self.listed(messages):
            system.move(file.path, f"{root}/{file.path.rsplit('/', 1)[-1]}")


class AwardArchives(D.DataSource):
    """Writer only, to add archives. The rows need department, award_type, period_from and period_to beside the CSV columns."""

    @classmethod
    def name(cls) -> str:
        return ARCHIVES

    def writer(self, schema: T.StructType, overwrite: bool) -> _ArchiveWriter:
        if overwrite:
            raise ValueError("archives are added, never replaced")
        return _ArchiveWriter(self.options["path"], schema)


def latest(path: str, version: int | None = None) -> dict | None:
    """The newest manifest of a table, or that of a version."""
    names = [p for p in files_in(f"{path}/manifests") if p.endswith(".json") and (version is None or p.endswith(f"/v{version:012d}.json"))]
    return read_json(names[-1]) if names else None


def register_sinks(spark: SparkSession) -> None:
    ship_package(spark)
    spark.dataSource.register(AwardTable)
    spark.dataSource.register(AwardArchives)


def commit_table(df: DataFrame, path: str, partitions: list[str] = (), mode: str = "overwrite", run: str = "") -> dict:
    """Write and commit a table; returns its manifest. Tasks write the rows of one combination of partition values after another."""
    register_sinks(df.sparkSession)
    df = df.sortWithinPartitions(*partitions) if partitions else df
    df.write.format(TABLE).mode(mode).options(partitions=",".join(partitions), run=run).save(path)
    return latest(path)


def commit_awards(df: DataFrame, path: str, mode: str = "overwrite", run: str = "") -> dict:
    """Processed awards by award type and department; the rebalance hint splits a department that holds most of the rows."""
    return commit_table(df.hint("rebalance", "award_type", "department"), path, ["award_type", "department"], mode, run)


def commit_predictions(df: DataFrame, path: str, run: str) -> dict:
    """All scored awards by falling score: file by file, in the order of the manifest."""
    return commit_table(by_score(df).withColumn("run_ts", F.lit(run)), path, run=run)


def commit_review(df: DataFrame, path: str, run: str = "") -> dict:
    """The awards for review, by falling score."""
    return commit_table(by_score(review_projection(df), tie="piid"), path, run=run)


def write_archives(df: DataFrame, path: str) -> None:
    """Add rows to a folder of zipped dumps, about one archive for each name; a name with very many rows gets several."""
    register_sinks(df.sparkSession)
    dealt = df.hint("rebalance", *_NAMED).sortWithinPartitions(*_NAMED)
    dealt.write.format(ARCHIVES).mode("append").save(path)


def read_committed(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a table as of its newest manifest, or of a version."""
    found = latest(path, version)
    if found is None:
        raise FileNotFoundError(f"nothing is committed in {path}")
    shape = T.StructType.fromJson(json.loads(found["schema"]))
    if not found["files"]:
        return spark.createDataFrame([], shape)
    system, _ = locate(path)
    return spark.read.schema(shape).parquet(*[plain_address(system, path, f["path"]) for f in found["files"]])


def committed_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(place, path, rows, bytes, and the partition values as text) of the files of a table."""
    found = latest(path, version)
    if found is None:
        raise FileNotFoundError(f"nothing is committed in {path}")
    shape = T.StructType([T.StructField("place", T.LongType()), T.StructField("path", T.StringType()), T.StructField("rows", T.LongType()),
                          T.StructField("bytes", T.LongType()), *[T.StructField(c, T.StringType()) for c in found["columns"]]])
    system, _ = locate(path)
    return spark.createDataFrame([(k, plain_address(system, path, f["path"]), f["rows"], f["bytes"], *f["values"]) for k, f in enumerate(found["files"])], shape)


def committed_summary(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Rows and files for each combination of partition values, from the commit messages alone."""
    files = committed_files(spark, path, version)
    keys = files.columns[4:]
    return files.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"))
