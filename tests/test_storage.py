"""The dump data source and the committing sinks."""

import datetime
import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from awardsift import commits, sources
from awardsift.sources import dumpsource
from tests.test_sources import dumps  # noqa: F401

ROOT = Path(__file__).resolve().parent.parent


def test_source_gives_the_rows_of_the_reader(spark, dumps):  # noqa: F811
    columns = ["path", "member", "row_no", "file_name", *sources.dumps.schema.RAW_DUMP.names]
    known = sources.parse_dump_names(sources.list_archives(spark, dumps))
    expected = {tuple(r) for r in sources.read_zipped_csv(spark, known).select(*columns).collect()}
    for pack in ("0", str(dumpsource.PACK)):
        assert {tuple(r) for r in dumpsource.read_dumps(spark, dumps, packBytes=pack).select(*columns).collect()} == expected and len(expected) == 10
    assert [r.error for r in dumpsource.rejected_dumps(spark, dumps).collect()] == ["File is not a zip file"]


def test_selection_opens_no_other_archives(spark, dumps):  # noqa: F811
    """A broken archive that is ruled out does no harm, and no partition is made for others."""
    def read(**chosen):
        return dumpsource.read_dumps(spark, dumps, ["award_id_piid", "department"], packBytes="0", **dumpsource.selecting(**chosen))

    energy = read(departments=["department OF energy"], award_types=["contracts"], since="2024-03-31")
    assert energy.rdd.getNumPartitions() == 2 and energy.count() == 7
    assert read(departments=["Department of Labor"]).count() == 0 and read(departments=[]).count() == 0
    assert read(until="2023-12-31").count() == 1  # the one whose name has no period
    assert read(departments=["doe", "sba"], award_types=["grants", "contracts"]).count() == 10
    # a frame is used twice in one query, filtered in two ways
    rows = dumpsource.read_dumps(spark, dumps, ["award_id_piid", "award_type"])
    assert rows.where("award_type = 'grants'").union(rows.where("award_type = 'contracts'")).count() == 10


def test_names_of_archives():
    found = dumpsource.described("file:/x/department_of_energy_grants_2024-01-01_to_2024-03-31.zip")
    assert (found["department"], found["acronym"], found["award_type"], found["period_to"]) == ("Department of Energy", "DOE", "grants", datetime.date(2024, 3, 31))
    assert dumpsource.described("file:/x/moon_office_grants_1.zip") is None and dumpsource.described("file:/x/department_of_energy_2024.zip") is None
    assert dumpsource.described("/x/department_of_energy_grants_2024-13-01_to_2024-03-31.zip")["period_from"] is None


def test_wrong_columns_are_refused(spark, dumps):  # noqa: F811
    dumpsource.register_dumps(spark)
    with pytest.raises(Exception, match="no column nothing"):
        spark.read.format("award_dump").schema("nothing string").load(dumps).count()


def _zip(path, ids):
    with zipfile.ZipFile(path, "w") as archive:
        archive.writestr("a.csv", "award_id_piid\n" + "".join(f"{i}\n" for i in ids))


def test_stream_reads_each_archive_once(spark, tmp_path):
    """Archives come in three deliveries, the stream starts anew for each; a batch takes two archives at most."""
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()

    def run(trigger):
        rows = dumpsource.stream_dumps(spark, str(raw), str(tmp_path / "manifest"), ["award_id_piid", "file_name"], maxArchives="2")
        query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(**trigger).start()
        if "processingTime" in trigger:
            query.processAllAvailable()
            query.stop()
        query.awaitTermination()

    for delivery in range(3):
        for k in range(2):
            _zip(raw / f"department_of_energy_grants_2024-0{delivery + 1}-01_to_2024-0{delivery + 1}-28_{k}.zip", [f"{delivery}{k}{i}" for i in range(3)])
        run({"availableNow": True} if delivery < 2 else {"processingTime": "0 seconds"})
    ids = sorted(r.award_id_piid for r in spark.read.parquet(out).collect())
    assert ids == sorted(f"{d}{k}{i}" for d in range(3) for k in range(2) for i in range(3))
    taken = dumpsource.manifest(spark, str(tmp_path / "manifest")).collect()
    assert len(taken) == len({r.path for r in taken}) == 6 and {r.version for r in taken} == {1, 2, 3}


def test_manifest_entries_are_never_replaced(tmp_path):
    dumpsource.write_new(str(tmp_path / "m"), "v1.json", {"a": 1})
    with pytest.raises(FileExistsError):
        dumpsource.write_new(str(tmp_path / "m"), "v1.json", {"a": 2})
    assert json.loads((tmp_path / "m" / "v1.json").read_text()) == {"a": 1} and os.listdir(tmp_path / "m") == ["v1.json"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_committed_table(spark, tmp_path):
    """Appends and overwrites are versions; values that file names cannot hold, nulls, and a table without rows."""
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a/b", 1), (None, 2), ("ü ?=*[x]{y}", 3)], "kind string, n int")
    commits.commit_table(first, path, ["kind"])
    commits.commit_table(first.where("n = 3").withColumn("n", F.lit(4)), path, ["kind"], "append", "second")
    assert rows_of(commits.read_committed(spark, path, 1)) == rows_of(first)
    assert sorted(r.n for r in commits.read_committed(spark, path).collect()) == [1, 2, 3, 4]
    assert {(r.kind, r.rows) for r in commits.committed_summary(spark, path).collect()} == {("a/b", 1), (None, 1), ("ü ?=*[x]{y}", 2)}
    with pytest.raises(Exception, match="do not have the columns"):
        commits.commit_table(first.withColumn("n", F.lit("x")), path, mode="append")
    commits.commit_table(first.limit(0), path)
    assert commits.read_committed(spark, path).count() == 0 and commits.latest(path)["version"] == 3
    assert commits.read_committed(spark, path, 2).count() == 4
    with pytest.raises(FileNotFoundError):
        commits.read_committed(spark, str(tmp_path / "nothing"))


def test_failed_run_changes_nothing(spark, tmp_path):
    """A task fails after others have finished: the table is as before, and the files of the run are gone."""
    path = str(tmp_path / "table")
    commits.commit_table(spark.range(50).toDF("n"), path)

    def fail(batches):
        for batch in batches:
            yield batch
            if 999 in batch.column(0).to_pylist():
                raise RuntimeError("this task fails")

    with pytest.raises(Exception, match="this task fails"):
        commits.commit_table(spark.range(1000, numPartitions=4).toDF("n").mapInArrow(fail, "n long"), path)
    assert commits.read_committed(spark, path).count() == 50 and commits.latest(path)["version"] == 1
    listed = {f["path"] for f in commits.latest(path)["files"]}
    assert {str(p) for p in Path(path).rglob("*.parquet")} == listed


def test_killed_task_is_repeated(tmp_path):
    """A worker process dies in the middle of its rows; the task runs again and the table holds each row once."""
    script = f"""
import os, sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark import TaskContext
from awardsift import commits
from awardsift.session import local_session
spark = local_session('2,4')
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
class Dying(commits._TableWriter):
    def write(self, iterator):
        def dying():
            for k, batch in enumerate(iterator):
                if k == 2 and TaskContext.get().partitionId() == 1 and TaskContext.get().attemptNumber() < 2:
                    os._exit(1)
                yield batch
        return super().write(dying())
class Source(commits.AwardTable):
    @classmethod
    def name(cls): return "dying"
    def writer(self, schema, overwrite): return Dying(self.options["path"], schema, overwrite, [], "")
spark.dataSource.register(Source)
spark.range(3000, numPartitions=3).write.format("dying").mode("overwrite").save({str(tmp_path / 't')!r})
print("ROWS", commits.read_committed(spark, {str(tmp_path / 't')!r}).distinct().count(), sum(f["rows"] for f in commits.latest({str(tmp_path / 't')!r})["files"]))
"""
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(ROOT)})
    assert "ROWS 3000 3000" in out.stdout, out.stderr[-2000:]


def test_many_values_in_a_task(spark, tmp_path, monkeypatch):
    """More values than files may be open at once."""
    rows = spark.range(400).selectExpr("id % 150 AS kind", "id").repartition(1)
    commits.register_sinks(spark)
    rows.write.format("award_table").mode("overwrite").options(partitions="kind").save(str(tmp_path / "t"))
    assert commits.read_committed(spark, str(tmp_path / "t")).distinct().count() == 400
    assert commits.committed_summary(spark, str(tmp_path / "t")).count() == 150


def test_predictions_in_order(spark, tmp_path):
    scored = spark.range(500).selectExpr("CAST(id AS STRING) AS piid", "CAST(id * 7919 % 500 AS DOUBLE) AS anomaly_score")
    commits.commit_predictions(scored, str(tmp_path / "p"), "run1")
    found = [spark.read.parquet(r.path).collect() for r in commits.committed_files(spark, str(tmp_path / "p")).orderBy("place").collect()]
    scores = [r.anomaly_score for part in found for r in part]
    assert scores == sorted(scores, reverse=True) and len(scores) == 500 and {r.run_ts for part in found for r in part} == {"run1"}


def test_archives_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Department of Energy", "grants", datetime.date(2024, 1, 1), datetime.date(2024, 3, 31), f"g{k}", 'a "quoted", text\nline') for k in range(20)],
                                 "department string, award_type string, period_from date, period_to date, award_id_fain string, award_description string")
    commits.write_archives(rows, str(tmp_path / "d"))
    back = dumpsource.read_dumps(spark, str(tmp_path / "d"), [*rows.columns])
    assert rows_of(back.select(*rows.columns)) == rows_of(rows)
    with pytest.raises(Exception, match="never replaced"):
        rows.write.format("award_archives").mode("overwrite").save(str(tmp_path / "d"))


def test_columns_are_decoded_as_a_whole():
    """Values that are UTF-8 read as Latin-1, true Latin-1 and nulls; a column without any such letter is not walked through."""
    import io

    import pandas as pd

    from awardsift.sources import dumps as reader

    data = io.BytesIO('a,b\n"é, ""q""",\nx,1\n'.encode() + b"\xe9t\xe9,2\n")
    (rows,) = reader._chunks(data, "p", "m", ["a", "b", "c"])
    assert rows.to_pydict() == {"path": ["p"] * 3, "member": ["m"] * 3, "row_no": [0, 1, 2], "a": ['é, "q"', "x", "été"], "b": [None, "1", "2"], "c": [None] * 3}
    assert reader._decoded(pd.Series(["a", None, "b"], dtype=object)).to_pylist() == ["a", None, "b"]


def test_rows_by_values_keep_their_order():
    import pyarrow as pa

    day = datetime.date(2024, 1, 1)
    batch = pa.RecordBatch.from_pydict({"k": ["b", None, "a", "b", None], "d": [day, day, None, day, day], "v": [1, 2, 3, 4, 5]})
    assert [(values, rows["v"].to_pylist()) for values, rows in commits.by_values(batch, ["k", "d"])] == [(("b", day), [1, 4]), ((None, day), [2, 5]), (("a", None), [3])]
