"""Raw dumps to one row per active award.

One lazy plan covers all departments, award types and files: department and type are columns, not
loops, and nothing is written in between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import amount
from ..operators.aggregates import rollup_awards, run_summary
from ..operators.filters import active, keyword_match, lenient_timestamp
from ..operators.schema_ops import description_fallback, end_date_fallback, ensure_columns
from ..schema import RAW_DUMP
from ..sinks import write_awards, write_records, write_summary
from ..sources import archive_members, list_archives, parse_dump_names, read_zipped_csv, rejected_archives, select_dumps

GROUP = ["award_type", "department", "acronym"]


def standard_columns(raw: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Standard names and types for a mixed table of contracts and grants, next to the ``keep`` columns.

    ``award_type`` picks the id and value columns per row; the fallback columns fill in for end date and
    description where a file lacks the main one.
    """
    contract = F.col("award_type") == "contracts"
    whole = description_fallback(end_date_fallback(ensure_columns(raw, RAW_DUMP), "_end"), "_text")
    return whole.select(
        *[c for c in (*GROUP, *keep) if c in raw.columns],
        F.when(contract, F.col("award_id_piid")).otherwise(F.col("award_id_fain")).alias("piid"),
        F.col("_text").alias("description"),
        amount(F.when(contract, F.col("current_total_value_of_award")).otherwise(F.col("total_obligated_amount")).cast("string")).alias("value"),
        lenient_timestamp(F.col("_end")).alias("end_date"),
        F.col("recipient_name").alias("vendor"),
        F.col("awarding_agency_name").alias("agency"),
    )


def award_etl(
    raw: DataFrame, as_of: str, words: list[str] | None = None, mode: str = "substring", rollup: bool = True,
    order: list[str] = ("path", "member", "row_no"),
) -> DataFrame:
    """Active awards, optionally only those with a keyword, one row per id within type and department.

    ``raw`` has the dump columns plus ``award_type`` and, if known, ``department`` and ``acronym``. ``order``
    says which row comes first when texts differ; it should tell the rows of an award apart. ``rollup=False`` keeps all rows.
    """
    missing = [c for c in order if c not in raw.columns]
    if rollup and missing:
        raise ValueError(f"cannot order the rows of an award: no columns {missing}")
    awards = keyword_match(active(standard_columns(raw, order), as_of), "description", words, mode)
    if not rollup:
        return awards.drop(*order)
    keys = [c for c in GROUP if c in awards.columns]
    return rollup_awards(awards, [*keys, "piid"], list(order))


def etl_dumps(
    spark: SparkSession, path: str, as_of: str, words: list[str] | None = None, mode: str = "substring",
    departments: list[str] | None = None, award_types: list[str] | None = None, members: DataFrame | None = None,
) -> DataFrame:
    """The archives under ``path`` whose names give a known department and an award type, or only the named ones.

    Other archives are never opened. ``members`` is ``dump_members``' table, if the caller has it.
    """
    members = dump_members(spark, path, departments, award_types) if members is None else members
    named = parse_dump_names(read_zipped_csv(spark, members, members=members))
    return award_etl(named, as_of, words, mode)


def dump_members(spark: SparkSession, path: str, departments: list[str] | None = None, award_types: list[str] | None = None) -> DataFrame:
    """CSV members of the selected archives, and the archives that cannot be read."""
    return archive_members(spark, select_dumps(parse_dump_names(list_archives(spark, path)), departments, award_types))


def process_dumps(
    spark: SparkSession, path: str, out: str, as_of: str, words: list[str] | None = None, mode: str = "substring",
    departments: list[str] | None = None, award_types: list[str] | None = None,
) -> DataFrame:
    """Run the ETL, write the awards, a summary and the rejected archives, and return the summary: department -> {type -> folder}.

    Departments and types without any award have no folder and are left out. Archives that cannot be read are in
    ``<out>/rejected`` with their errors.
    """
    members = dump_members(spark, path, departments, award_types)
    write_awards(etl_dumps(spark, path, as_of, words, mode, members=members), f"{out}/awards")
    write_records(rejected_archives(members), f"{out}/rejected")
    written = spark.read.parquet(f"{out}/awards").select("award_type", "department", "acronym").distinct()
    folder = F.concat(F.lit(f"{out}/awards/award_type="), "award_type", F.lit("/department="), "department")
    outputs = written.select(F.col("acronym").alias("department"), "award_type", folder.alias("path"))
    write_summary(outputs, f"{out}/summary")
    return run_summary(outputs)
