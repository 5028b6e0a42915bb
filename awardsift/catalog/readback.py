"""Files in the formats of the jobs: written to the shared folder, found and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..commits import write_archives
from ..constants import DEPARTMENTS
from ..plans.etl import process_dumps
from ..session import checkpoint
from ..sinks import write_predictions, write_review, write_snapshot
from ..sources import latest_snapshot, read_awards, read_labeled
from .base import AWARDS, SCORED, awards, new_folder, query, scored

_NAMES = list(DEPARTMENTS)
_SQL_NAMES = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_WORDS = ["gear", "anvil", "copper"]
_RUN = "20240102030405"


@query(f"""
WITH {AWARDS} SELECT piid, agency, vendor, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, description, CAST(part_no AS BIGINT) AS savings
FROM awards WHERE line_no = 2 AND supp_no % 9 > 0""")
def labeled_snapshot(spark, folder):
    """The newer of two snapshots is found and read; placeholder ids go."""
    rows, path = awards(spark, folder), new_folder(spark, "labeled")
    piid = F.when(F.col("supp_no") % 9 == 0, "Unavailable").otherwise(F.col("piid"))
    for line, run in ((1, "20240101000000"), (2, "20240201000000")):
        write_snapshot(rows.where(F.col("line_no") == line).select(
            piid.alias("piid"), "agency", "vendor", F.col("value").cast("decimal(18,2)").cast("string").alias("value"), "description",
            F.col("part_no").cast("long").alias("savings")), path, "labeled", run)
    return read_labeled(spark, latest_snapshot(spark, path)).select("piid", "agency", "vendor", "value", "description", "savings")


@query(f"""
WITH {AWARDS} SELECT piid || '-' || line_no || '-' || part_no AS piid, CASE WHEN line_no % 3 > 0 THEN description || ', é' END AS description,
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value, strftime(end_date, '%Y-%m-%d') AS end_date, vendor, agency FROM awards""")
def award_files(spark, folder):
    """A directory of JSON and CSV files."""
    rows, path = awards(spark, folder), new_folder(spark, "files")
    plain = rows.select(
        F.concat_ws("-", "piid", "line_no", "part_no").alias("piid"), F.when(F.col("line_no") % 3 > 0, F.concat("description", F.lit(", é"))).alias("description"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "vendor", "agency", "line_no")
    plain.where("line_no % 2 = 0").drop("line_no").write.mode("append").json(path)
    plain.where("line_no % 2 = 1").drop("line_no").write.mode("append").option("header", True).option("escape", '"').csv(path)
    return read_awards(spark, path).select("piid", "description", "value", "end_date", "vendor", "agency")


@query(f"WITH {SCORED} SELECT piid, line_no, supp_no, part_no, round(anomaly_score, 9) AS anomaly_score, for_review, '{_RUN}' AS run_ts FROM scored")
def predictions_file(spark, folder):
    rows = checkpoint(scored(spark, folder).select("piid", "line_no", "supp_no", "part_no", "anomaly_score", "for_review"))
    back = spark.read.parquet(write_predictions(rows, new_folder(spark, "out"), _RUN))
    return back.select("piid", "line_no", "supp_no", "part_no", F.round("anomaly_score", 9).alias("anomaly_score"), "for_review", "run_ts")


@query(f"WITH {SCORED} SELECT piid, vendor, agency, round(anomaly_score, 9) AS anomaly_score FROM scored WHERE for_review")
def review_file(spark, folder):
    path = write_review(checkpoint(scored(spark, folder)), new_folder(spark, "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    return back.select("piid", "vendor", "agency", F.round(F.col("anomaly_score").cast("double"), 9).alias("anomaly_score"))


@query(f"""
WITH {AWARDS} SELECT award_type, department, piid || '-' || line_no || '-' || supp_no || '-' || part_no AS piid, description,
  CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS value, strftime(end_date, '%Y-%m-%d') AS end_day, vendor, agency
FROM (SELECT *, CASE WHEN return_flag = 'A' THEN 'grants' ELSE 'contracts' END AS award_type, ({_SQL_NAMES})[1 + supp_no % {len(_NAMES)}] AS department FROM awards)
WHERE department IN ('{_NAMES[2]}', '{_NAMES[7]}') AND end_date > TIMESTAMP '1996-06-30'
  AND ({' OR '.join(f"contains(lower(description), '{w}')" for w in _WORDS)})""")
def dump_job(spark, folder):
    """The whole job on two departments: archives are chosen by name, read, filtered, rolled up, written and summarised."""
    a, raw, out = awards(spark, folder), new_folder(spark, "dumps"), new_folder(spark, "processed")
    piid, grant, year = F.concat_ws("-", "piid", "line_no", "supp_no", "part_no"), F.col("return_flag") == "A", F.year("end_date")
    value = F.col("value").cast("decimal(18,2)").cast("string")
    write_archives(a.select(
        F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("supp_no") % len(_NAMES) + 1).cast("int")).alias("department"),
        F.when(grant, "grants").otherwise("contracts").alias("award_type"), F.make_date(year, F.lit(1), F.lit(1)).alias("period_from"),
        F.make_date(year, F.lit(12), F.lit(31)).alias("period_to"), F.when(~grant, piid).alias("award_id_piid"), F.when(grant, piid).alias("award_id_fain"),
        F.col("description").alias("prime_award_base_transaction_description"), F.when(~grant, value).alias("current_total_value_of_award"),
        F.when(grant, value).alias("total_obligated_amount"), F.date_format("end_date", "yyyy-MM-dd").alias("period_of_performance_current_end_date"),
        F.col("vendor").alias("recipient_name"), F.col("agency").alias("awarding_agency_name")), raw)
    process_dumps(spark, raw, out, "1996-06-30", _WORDS, departments=[_NAMES[2].upper(), _NAMES[7]])
    done = spark.read.parquet(f"{out}/awards")
    return done.select("award_type", "department", "piid", "description", "value", F.date_format("end_date", "yyyy-MM-dd").alias("end_day"), "vendor", "agency")
