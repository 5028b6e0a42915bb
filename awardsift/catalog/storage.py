"""Sources and sinks: rows of the test tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..commits import commit_awards, commit_table, committed_summary, read_committed, write_archives
from ..constants import DEPARTMENTS
from ..sources.dumpsource import manifest, read_dumps, selecting, stream_dumps
from .base import AWARDS, awards, new_folder, query

_NAMES = list(DEPARTMENTS)
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_SQL_ACRONYMS = "[" + ", ".join(f"'{a}'" for a in DEPARTMENTS.values()) + "]"


# Dump rows: department by supplier, type by return flag, period by year; texts with commas, quotes and line ends.
_DUMPED = f"""{AWARDS}, dumped AS (
  SELECT ({_SQL_NAMES})[1 + supp_no % {len(_NAMES)}] AS department, ({_SQL_ACRONYMS})[1 + supp_no % {len(_NAMES)}] AS acronym,
    CASE WHEN return_flag = 'A' THEN 'grants' ELSE 'contracts' END AS award_type, strftime(end_date, '%Y-01-01') AS period_from,
    piid || '-' || line_no || '-' || part_no AS award_id_piid,
    CASE WHEN line_no % 3 = 0 THEN NULL WHEN line_no % 3 = 1 THEN description || ', "é' || chr(10) || '#' ELSE description END AS description,
    CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS current_total_value_of_award, vendor AS recipient_name
  FROM awards)"""


def _dumped(spark, folder):
    a = awards(spark, folder)
    text = F.when(F.col("line_no") % 3 == 1, F.concat("description", F.lit(', "é\n#'))).when(F.col("line_no") % 3 == 2, F.col("description"))
    year = F.year("end_date")
    return a.select(
        F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("supp_no") % len(_NAMES) + 1).cast("int")).alias("department"),
        F.when(F.col("return_flag") == "A", "grants").otherwise("contracts").alias("award_type"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("period_from"), F.make_date(year, F.lit(12), F.lit(31)).alias("period_to"),
        F.concat_ws("-", "piid", "line_no", "part_no").alias("award_id_piid"), text.alias("description"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("current_total_value_of_award"), F.col("vendor").alias("recipient_name"),
    )


_READ = ["department", "acronym", "award_type", "period_from", "award_id_piid", "description", "current_total_value_of_award", "recipient_name"]


@query(f"WITH {_DUMPED} SELECT department, acronym, award_type, period_from, award_id_piid, description, current_total_value_of_award, recipient_name FROM dumped")
def dump_source_rows(spark, folder):
    """All rows, out to archives and back through the data source."""
    path = new_folder(spark, "dumps")
    write_archives(_dumped(spark, folder), path)
    return read_dumps(spark, path, _READ).withColumn("period_from", F.col("period_from").cast("string"))


@query(f"""
WITH {_DUMPED} SELECT acronym, count(*) AS n, count(description) AS described, min(award_id_piid) AS first_id FROM dumped
WHERE award_type = 'grants' AND department IN ('{_NAMES[3]}', '{_NAMES[5]}', '{_NAMES[8]}') AND period_from >= '1995-01-01' AND recipient_name IS NOT NULL
GROUP BY acronym""")
def dump_source_selected(spark, folder):
    """Department, type and period choose the archives that are opened."""
    path = new_folder(spark, "dumps")
    write_archives(_dumped(spark, folder), path)
    chosen = selecting([_NAMES[3], _NAMES[5].upper(), DEPARTMENTS[_NAMES[8]]], ["grants"], since="1995-01-01")
    rows = read_dumps(spark, path, ["acronym", "award_id_piid", "description", "recipient_name"], **chosen).where(F.col("recipient_name").isNotNull())
    return rows.groupBy("acronym").agg(F.count(F.lit(1)).alias("n"), F.count("description").alias("described"), F.min("award_id_piid").alias("first_id"))


@query(f"""
WITH {_DUMPED}, read AS (SELECT acronym, award_type, count(*) AS n, count(DISTINCT award_id_piid) AS ids FROM dumped GROUP BY ALL)
SELECT acronym, award_type, n, ids, (SELECT count(*) FROM (SELECT DISTINCT department, award_type, period_from FROM dumped)) AS names FROM read""")
def dump_source_stream(spark, folder):
    """Archives that land in two deliveries are read by a stream that is stopped in between, each archive once."""
    path, taken, state, out = (new_folder(spark, name) for name in ("dumps", "manifest", "state", "streamed"))
    rows = _dumped(spark, folder)
    for delivery in (F.col("award_type") == "grants", F.col("award_type") != "grants"):
        write_archives(rows.where(delivery), path)
        stream = stream_dumps(spark, path, taken, ["acronym", "award_type", "award_id_piid"])
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    read = spark.read.parquet(out).groupBy("acronym", "award_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("award_id_piid").alias("ids"))
    stem = F.regexp_extract("file_name", r"^(.+_to_\d{4}-\d{2}-\d{2})", 1)
    return read.crossJoin(F.broadcast(manifest(spark, taken).agg(F.count_distinct(stem).alias("names"))))  # one row


_COMMITTED = f"""{AWARDS}, typed AS (
  SELECT CASE WHEN return_flag = 'A' THEN 'grants' ELSE 'contracts' END AS award_type, agency AS department, piid, line_no, supp_no, part_no, value,
         strftime(end_date, '%Y-%m-%d') AS end_day FROM awards)"""


def _typed(spark, folder):
    return awards(spark, folder).select(F.when(F.col("return_flag") == "A", "grants").otherwise("contracts").alias("award_type"), F.col("agency").alias("department"),
                                        "piid", "line_no", "supp_no", "part_no", "value", "end_date")


@query(f"WITH {_COMMITTED} SELECT * FROM typed")
def committed_awards(spark, folder):
    """Two runs are committed one after the other; the table is what its newest manifest lists."""
    path, rows = new_folder(spark, "awards"), _typed(spark, folder)
    commit_awards(rows.where("award_type = 'grants'"), path)
    commit_awards(rows.where("award_type = 'contracts'"), path, "append")
    return read_committed(spark, path).withColumn("end_day", F.date_format("end_date", "yyyy-MM-dd")).drop("end_date")


@query(f"WITH {_COMMITTED} SELECT award_type, department, count(*) AS rows FROM typed GROUP BY ALL")
def committed_run_summary(spark, folder):
    """Rows by type and department, from the messages of the tasks that wrote them."""
    path = new_folder(spark, "awards")
    commit_awards(_typed(spark, folder), path)
    return committed_summary(spark, path).select("award_type", "department", "rows")


@query(f"WITH {AWARDS} SELECT line_no, count(*) AS n, sum(part_no)::BIGINT AS parts FROM awards WHERE line_no <> 1 GROUP BY ALL")
def committed_versions(spark, folder):
    """An overwritten table: the newest version holds the new rows alone, the one before stays readable."""
    path = new_folder(spark, "versions")
    rows = awards(spark, folder).select("line_no", "part_no")
    commit_table(rows.where("line_no > 2"), path, ["line_no"])
    commit_table(rows.where("line_no <= 2"), path, ["line_no"])
    both = read_committed(spark, path, 1).unionByName(read_committed(spark, path)).where("line_no <> 1")
    return both.groupBy("line_no").agg(F.count(F.lit(1)).alias("n"), F.sum("part_no").alias("parts"))
