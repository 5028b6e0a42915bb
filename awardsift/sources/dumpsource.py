"""Award dumps as a data source: ``spark.read.format("award_dump")`` and ``spark.readStream.format("award_dump")``.

A partition is one CSV member of an archive, or several small ones. What an archive's name says (department, type, period) is a
column, and a selection by these is given to the source: archives that it rules out are not opened, let alone inflated. A
schema given to the reader prunes the columns that are parsed. The directories of the archives that remain are read side
by side on the driver, a few KB each; rows are read in tasks.

The selection is an option and not a pushed filter, because in Spark 4.1 all uses of one frame share what the last pushed
filters left of a Python source: a union of two differently filtered uses returns wrong rows.

The stream's offset is the version of a manifest: a folder of small files, one a version, that name the archives
which were new then. A version is written before Spark hears of it and never changes, so a batch that is repeated reads the
same archives, each archive is read once, and ``manifest`` shows which ones were.
"""

from __future__ import annotations

import datetime
import json
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from .. import schema
from ..constants import AWARD_TYPES, DEPARTMENTS
from ..session import ship_package
from .dumps import _chunks
from .paths import files_in, open_path, read_json, write_new

FORMAT = "award_dump"
READERS = 32
#: Small members share a partition up to PACK bytes inflated; each counts OPENING bytes more, as an archive must be opened for it.
PACK, OPENING = 128 << 20, 4 << 20
#: What is known of a row before its archive is opened.
NAMED = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("department", T.StringType()),
    T.StructField("acronym", T.StringType()), T.StructField("award_type", T.StringType()), T.StructField("period_from", T.DateType()),
    T.StructField("period_to", T.DateType()),
])
ROWS = T.StructType([*NAMED, T.StructField("member", T.StringType()), T.StructField("row_no", T.LongType()), *schema.RAW_DUMP])
ARCHIVES = T.StructType([*NAMED, T.StructField("members", T.LongType()), T.StructField("error", T.StringType())])

_NAME = re.compile(rf"^(?P<department>.+?)_(?P<type>{'|'.join(AWARD_TYPES)})_")
_PERIOD = re.compile(r"(\d{4}-\d{2}-\d{2})_to_(\d{4}-\d{2}-\d{2})")
_KNOWN = {name.lower(): (name, acronym) for name, acronym in DEPARTMENTS.items()}


def _day(text: str) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text)
    except ValueError:
        return None


def described(path: str, known: dict[str, tuple[str, str]] = _KNOWN) -> dict | None:
    """What an archive's name says; None if it names no award type or no known department."""
    name = path.rsplit("/", 1)[-1]
    found = _NAME.match(name)
    department = known.get(found["department"].replace("_", " ").lower()) if found else None
    if department is None:
        return None
    period = _PERIOD.search(name)
    days = (_day(period[1]), _day(period[2])) if period else (None, None)
    return {"path": path, "file_name": name, "department": department[0], "acronym": department[1], "award_type": found["type"],
            "period_from": days[0], "period_to": days[1]}


@dataclass(frozen=True)
class Selection:
    """Archives by name: departments and types (None: all), and a period that theirs must meet; without a period in its name an archive stays."""

    departments: tuple[str, ...] | None = None
    award_types: tuple[str, ...] | None = None
    since: datetime.date | None = None
    until: datetime.date | None = None

    @classmethod
    def of(cls, options: dict[str, str]) -> Selection:
        names, kinds = (tuple(json.loads(options[key])) if key in options else None for key in ("departments", "awardTypes"))
        since, until = (datetime.date.fromisoformat(options[key]) if key in options else None for key in ("since", "until"))
        return cls(None if names is None else tuple(n.lower() for n in names), kinds, since, until)

    def takes(self, archive: dict) -> bool:
        return (
            (self.departments is None or archive["department"].lower() in self.departments or archive["acronym"].lower() in self.departments)
            and (self.award_types is None or archive["award_type"] in self.award_types)
            and (self.since is None or archive["period_to"] is None or archive["period_to"] >= self.since)
            and (self.until is None or archive["period_from"] is None or archive["period_from"] <= self.until)
        )


@dataclass
class Member(D.InputPartition):
    """One CSV member; without a member, an archive itself (for the table of archives)."""

    archive: dict
    member: str | None = None
    size: int = 0
    members: int | None = None
    error: str | None = None


@dataclass
class Pack(D.InputPartition):
    """Members that one task reads."""

    members: list[Member]


def packed(members: list[Member], limit: int) -> list[Pack]:
    packs, held = [], limit
    for member in members:
        cost = member.size + OPENING
        if held + cost > limit:
            packs.append(Pack([]))
            held = 0
        packs[-1].members.append(member)
        held += cost
    return packs


@dataclass
class Archives:
    """The archives of a folder, and how their rows are read."""

    path: str
    pattern: str
    recursive: bool
    wanted: T.StructType
    pack: int = PACK
    selection: Selection = Selection()
    departments: dict[str, tuple[str, str]] = field(default_factory=lambda: _KNOWN)

    def found(self) -> list[dict]:
        names = re.compile(self.pattern)
        listed = (described(p, self.departments) for p in files_in(self.path, self.recursive) if names.fullmatch(p.rsplit("/", 1)[-1]))
        return [a for a in listed if a is not None and self.selection.takes(a)]

    @staticmethod
    def directory(archive: dict) -> tuple[list[tuple[str, int]], str | None]:
        try:
            with open_path(archive["path"]) as stream, zipfile.ZipFile(stream) as opened:
                return [(m.filename, m.file_size) for m in opened.infolist() if m.filename.endswith(".csv")], None
        except zipfile.BadZipFile as error:
            return [], str(error)

    def directories(self, archives: list[dict]) -> Iterator[tuple[dict, list[tuple[str, int]], str | None]]:
        with ThreadPoolExecutor(READERS) as pool:
            for archive, (members, error) in zip(archives, pool.map(self.directory, archives)):
                yield archive, members, error

    def packs(self, archives: list[dict]) -> list[Pack]:
        return packed([Member(archive, *named) for archive, members, _ in self.directories(archives) for named in members], self.pack)

    def rows(self, pack: Pack) -> Iterator[pa.RecordBatch]:
        for member in pack.members:
            yield from self.member_rows(member)

    def member_rows(self, part: Member) -> Iterator[pa.RecordBatch]:
        """Rows of a member in the wanted columns, in their order."""
        own = [c for c in self.wanted.names if c in schema.RAW_DUMP.names]
        with open_path(part.archive["path"]) as stream, zipfile.ZipFile(stream) as opened, opened.open(part.member) as data:
            for batch in _chunks(data, part.archive["path"], part.member, own):
                yield pa.RecordBatch.from_arrays([self._column(batch, part.archive, c) for c in self.wanted.names], names=self.wanted.names)

    @staticmethod
    def _column(batch: pa.RecordBatch, archive: dict, name: str) -> pa.Array:
        if name in batch.schema.names:
            return batch.column(name)
        kind = pa.date32() if name in ("period_from", "period_to") else pa.string()
        return pa.repeat(pa.scalar(archive[name], kind), batch.num_rows)


class _Reader(D.DataSourceReader):
    def __init__(self, archives: Archives, whole: bool):
        self.archives, self.whole = archives, whole

    def partitions(self) -> list[Pack]:
        if self.whole:
            return packed([Member(a, None, 0, len(names), error) for a, names, error in self.archives.directories(self.archives.found())], self.archives.pack)
        return self.archives.packs(self.archives.found())

    def read(self, partition: Pack | None) -> Iterator:
        if partition is None:  # nothing was selected
            return
        if self.whole:
            for each in partition.members:
                row = {**each.archive, "members": each.members, "error": each.error}
                yield tuple(row[c] for c in self.archives.wanted.names)
        else:
            yield from self.archives.rows(partition)


class _StreamReader(D.DataSourceStreamReader):
    def __init__(self, archives: Archives, manifest: str, most: int | None):
        self.archives, self.manifest, self.most = archives, manifest, most

    def initialOffset(self) -> dict:
        return {"version": 0}

    def _versions(self) -> list[str]:
        return [p for p in files_in(self.manifest) if re.fullmatch(r"v\d{12}\.json", p.rsplit("/", 1)[-1])]

    def latestOffset(self) -> dict:
        versions = self._versions()
        with ThreadPoolExecutor(READERS) as pool:
            seen = {p for entry in pool.map(read_json, versions) for p in entry["paths"]}
        new = sorted(a["path"] for a in self.archives.found() if a["path"] not in seen)[: self.most]
        if not new:
            return {"version": len(versions)}
        write_new(self.manifest, f"v{len(versions) + 1:012d}.json", {"version": len(versions) + 1, "paths": new})
        return {"version": len(versions) + 1}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        entries = [read_json(f"{self.manifest}/v{k:012d}.json") for k in range(start["version"] + 1, end["version"] + 1)]
        return self.archives.packs([described(p, self.archives.departments) for entry in entries for p in entry["paths"]])

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        yield from self.archives.rows(partition)


class AwardDump(D.DataSource):
    """Options: ``path``; ``pattern`` (a regular expression for file names, any .zip by default); ``recursive``; ``packBytes`` (0: a
    partition for each member); ``table`` = ``rows`` or ``archives`` (one row an archive with its number of members, or why it cannot be
    opened); ``departments``, ``awardTypes``, ``since`` and ``until`` (see ``selecting``); for streams ``manifest`` (a folder of its own) and ``maxArchives`` a batch.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _whole(self) -> bool:
        return self.options.get("table", "rows") == "archives"

    def schema(self) -> T.StructType:
        return ARCHIVES if self._whole() else ROWS

    def _archives(self, wanted: T.StructType) -> Archives:
        kinds = {f.name: f.dataType for f in self.schema()}
        for f in wanted:
            if kinds.get(f.name) != f.dataType:
                raise ValueError(f"no column {f.name} of type {f.dataType.simpleString()} in {FORMAT}")
        if "path" not in self.options:
            raise ValueError(f"{FORMAT} needs a path")
        return Archives(self.options["path"], self.options.get("pattern", r".*\.zip"), self.options.get("recursive", "false").lower() == "true", wanted,
                        int(self.options.get("packBytes", PACK)), Selection.of(self.options))

    def reader(self, schema: T.StructType) -> _Reader:
        return _Reader(self._archives(schema), self._whole())

    def streamReader(self, schema: T.StructType) -> _StreamReader:
        if "manifest" not in self.options:
            raise ValueError(f"a stream of {FORMAT} needs the option manifest")
        most = int(self.options["maxArchives"]) if "maxArchives" in self.options else None
        return _StreamReader(self._archives(schema), self.options["manifest"], most)


def register_dumps(spark: SparkSession) -> None:
    """Make the format known to a session."""
    ship_package(spark)
    spark.dataSource.register(AwardDump)


def pruned(columns: list[str]) -> T.StructType:
    """The schema of some columns of the source; only these are parsed."""
    return T.StructType([f for f in ROWS if f.name in columns])


def selecting(departments: list[str] | None = None, award_types: list[str] | None = None, since: str | None = None, until: str | None = None) -> dict[str, str]:
    """Options that choose archives by name: departments (or acronyms, in any case), types, and the days that a period must meet."""
    lists = {"departments": departments, "awardTypes": award_types}
    days = {"since": since, "until": until}
    return {**{k: json.dumps(v) for k, v in lists.items() if v is not None}, **{k: v for k, v in days.items() if v is not None}}


def read_dumps(spark: SparkSession, path: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Rows of the archives in a folder; ``**selecting(...)`` leaves archives unopened."""
    register_dumps(spark)
    reader = spark.read.format(FORMAT).options(**options)
    return (reader if columns is None else reader.schema(pruned(columns))).load(path)


def rejected_dumps(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(path, error) of the archives that cannot be opened."""
    return read_dumps(spark, path, table="archives", **options).where("error IS NOT NULL").select("path", "error")


def stream_dumps(spark: SparkSession, path: str, manifest: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """Rows of archives as they land, each archive once."""
    register_dumps(spark)
    reader = spark.readStream.format(FORMAT).options(manifest=manifest, **options)
    return (reader if columns is None else reader.schema(pruned(columns))).load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(version, file_name, path) of the archives that a stream has taken up."""
    entries = spark.read.schema("version long, paths array<string>").json(path)
    return entries.selectExpr("version", "explode(paths) AS path").selectExpr("version", "element_at(split(path, '/'), -1) AS file_name", "path")
