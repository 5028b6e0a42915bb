"""Joins with id sets, dimensions, manifests and date ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DEPARTMENTS
from ..functions import dump_file_name
from ..operators import joins as op
from ..operators.fusion import FusionModel
from ..operators.intervals import containing, overlapping
from ..session import checkpoint, measure
from ..sources.dumps import parse_dump_names, type_combos as combos
from .base import AWARDS, awards, query, sql_standardize, table

_NAMES = list(DEPARTMENTS)
_ASKED = [name.upper() if i % 2 else name.lower() for i, name in enumerate(_NAMES)] + ["Department of Nothing", "Moon Office"]
_SQL_ASKED = "[" + ", ".join(f"'{n}'" for n in _ASKED) + "]"
_SQL_DEPARTMENTS = "departments(name, acronym) AS (VALUES " + ", ".join(f"('{n}', '{a}')" for n, a in DEPARTMENTS.items()) + ")"


@query(f"""
WITH {AWARDS} SELECT piid, line_no, supp_no, part_no FROM awards
WHERE piid NOT IN (SELECT piid FROM awards WHERE return_flag = 'R' AND line_no = 1)""")
def labeled_anti_join(spark, folder):
    everything = awards(spark, folder)
    ids = checkpoint(op.distinct_ids(everything.where("return_flag = 'R' and line_no = 1")))
    return op.exclude_labeled(everything, ids, measure(ids)).select("piid", "line_no", "supp_no", "part_no")


@query(f"""
WITH {AWARDS} SELECT DISTINCT piid FROM (SELECT nullif(piid, '7') AS piid FROM awards WHERE return_flag = 'R') WHERE piid IS NOT NULL""")
def labeled_ids(spark, folder):
    return op.distinct_ids(awards(spark, folder).where("return_flag = 'R'").select(F.nullif("piid", F.lit("7")).alias("piid")))


@query(f"""
WITH {_SQL_DEPARTMENTS}, asked AS (
  SELECT o_orderkey, ({_SQL_ASKED})[1 + o_custkey % {len(_ASKED)}] AS department FROM orders)
SELECT o_orderkey, name AS department, acronym FROM asked JOIN departments ON lower(asked.department) = lower(name)""")
def department_lookup(spark, folder):
    names = F.array(*[F.lit(n) for n in _ASKED])
    asked = table(spark, folder, "orders").select(
        "o_orderkey", F.element_at(names, (F.col("o_custkey") % len(_ASKED) + 1).cast("int")).alias("department")
    )
    return op.add_acronym(asked).select("o_orderkey", "department", "acronym")


_SQL_FILE = """lower(replace(department, ' ', '_')) || '_' || award_type || '_' || strftime(o_orderdate, '%Y-%m-01') || '_to_' ||
  strftime(o_orderdate, '%Y-%m-28') || '.zip'"""
_SQL_ORDERS = f"""named AS (
  SELECT *, ({_SQL_ASKED})[1 + o_custkey % {len(_ASKED)}] AS department,
    CASE o_orderkey % 3 WHEN 0 THEN 'contracts' WHEN 1 THEN 'grants' ELSE 'leases' END AS award_type FROM orders)"""


def _order_files(spark, folder):
    """A dump file name per order: department by customer, type by order, period by month."""
    names = F.array(*[F.lit(n) for n in _ASKED])
    kind = F.when(F.col("o_orderkey") % 3 == 0, "contracts").when(F.col("o_orderkey") % 3 == 1, "grants").otherwise("leases")
    return table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", dump_file_name(
        F.element_at(names, (F.col("o_custkey") % len(_ASKED) + 1).cast("int")), kind,
        F.date_format("o_orderdate", "yyyy-MM-01"), F.date_format("o_orderdate", "yyyy-MM-28"),
    ).alias("file_name"))


@query(f"""
WITH {_SQL_ORDERS}, files AS (SELECT {_SQL_FILE} AS file_name, o_orderstatus FROM named)
SELECT DISTINCT file_name FROM files WHERE file_name NOT IN (SELECT file_name FROM files WHERE o_orderstatus = 'F')""")
def manifest_reconcile(spark, folder):
    files = _order_files(spark, folder)
    return op.missing_files(files.select("file_name").distinct(), files.where("o_orderstatus = 'F'"))


@query(f"""
WITH {_SQL_DEPARTMENTS}, {_SQL_ORDERS}
SELECT o_orderkey, name AS department, acronym, award_type FROM named JOIN departments ON lower(department) = lower(name)
WHERE award_type <> 'leases'""")
def dump_names(spark, folder):
    return parse_dump_names(_order_files(spark, folder)).select("o_orderkey", "department", "acronym", "award_type")


@query(f"""
WITH {_SQL_DEPARTMENTS}, {_SQL_ORDERS}
SELECT DISTINCT name AS department, acronym, award_type FROM named JOIN departments ON lower(department) = lower(name)
WHERE award_type <> 'leases'""")
def type_combos(spark, folder):
    return combos(parse_dump_names(_order_files(spark, folder)))


@query("""
WITH ranges AS (
  SELECT CAST(s AS DATE) AS range_start, least(CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE), DATE '2000-11-20') AS range_end
  FROM generate_series(TIMESTAMP '1996-02-10', TIMESTAMP '2000-11-19', INTERVAL 3 MONTH) t(s))
SELECT o_orderkey, strftime(range_start, '%Y-%m-%d') AS range_start, strftime(range_end, '%Y-%m-%d') AS range_end
FROM orders JOIN ranges ON CAST(o_orderdate AS DATE) BETWEEN range_start AND range_end""")
def quarter_range_join(spark, folder):
    rows = op.assign_range(table(spark, folder, "orders"), "1996-02-10", "2000-11-20", "o_orderdate")
    return rows.select("o_orderkey", F.col("range_start").cast("string").alias("range_start"), F.col("range_end").cast("string").alias("range_end"))


# Ranges of all lengths, from none to a month: sign-ups stay open for a time that depends on their id.
_SQL_OPEN = """open AS (
  SELECT event_id AS signup_id, ts AS opened, ts + to_microseconds(CASE WHEN event_id % 50 = 0 THEN 2592000000000 ELSE (event_id * event_id % 7200) * 1000000 END) AS closed
  FROM events WHERE event_type = 'signup')"""


def _open(spark, folder):
    micros = F.when(F.col("event_id") % 50 == 0, F.lit(2592000000000)).otherwise(F.col("event_id") * F.col("event_id") % 7200 * 1000000)
    return table(spark, folder, "events").where("event_type = 'signup'").select(
        F.col("event_id").alias("signup_id"), F.col("ts").cast("timestamp").alias("opened"), F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + micros).alias("closed"))


@query(f"""
WITH {_SQL_OPEN} SELECT signup_id, count(*) AS n, min(event_id) AS first_event, sum(user_id)::BIGINT AS users
FROM events JOIN open ON ts BETWEEN opened AND closed WHERE event_type = 'purchase' GROUP BY signup_id""")
def interval_events(spark, folder):
    """Purchases while a sign-up was open; the ranges overlap."""
    bought = table(spark, folder, "events").where("event_type = 'purchase'").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    bought = bought.withColumn("one", F.lit(1))
    return containing(bought, "ts", _open(spark, folder), "opened", "closed", per=["signup_id"],
                      totals={"n": ("count", "one"), "first_event": ("min", "event_id"), "users": ("sum", "user_id")})


@query(f"""
WITH {_SQL_OPEN}, errors AS (
  SELECT event_id AS error_id, ts AS began, ts + to_microseconds((event_id % 600) * 1000000) AS ended FROM events WHERE event_type = 'error')
SELECT error_id, count(*) AS n, min(signup_id) AS first_signup, sum(signup_id)::BIGINT AS signups
FROM errors JOIN open ON began <= closed AND opened <= ended GROUP BY error_id""")
def interval_overlaps(spark, folder):
    """Sign-ups that were open at some time of an error."""
    began = F.col("ts").cast("timestamp")
    errors = table(spark, folder, "events").where("event_type = 'error'").select(
        F.col("event_id").alias("error_id"), began.alias("began"), F.timestamp_micros(F.unix_micros(began) + F.col("event_id") % 600 * 1000000).alias("ended"))
    opened = _open(spark, folder).withColumn("one", F.lit(1))
    return overlapping(errors, "began", "ended", opened, "opened", "closed", per=["error_id"],
                       totals={"n": ("count", "one"), "first_signup": ("min", "signup_id"), "signups": ("sum", "signup_id")})


def sql_top(column: str, source: str, share: str = "0.2::DOUBLE") -> str:
    """CTEs <column>_top: the most frequent names of a column that already holds standardised names."""
    return f"""{column}_counts AS (
  SELECT {column} AS category, count(*) AS n FROM {source} WHERE lower({column}) <> 'unknown' GROUP BY ALL),
{column}_top AS (
  SELECT category, n FROM (
    SELECT *, row_number() OVER (ORDER BY n DESC, category) AS r, count(*) OVER () AS d FROM {column}_counts)
  WHERE r <= greatest(1, floor(d * {share})))"""


SQL_NAMED = f"""named AS (
  SELECT *, {sql_standardize("agency")} AS agency_name,
    {sql_standardize("CASE WHEN vendor IN ('Unavailable', 'DOMESTIC AWARDEES (UNDISCLOSED)') THEN 'Unknown' ELSE vendor END")} AS vendor_name
  FROM awards)"""


@query(f"""
WITH {AWARDS}, {SQL_NAMED}, {sql_top("agency_name", "named")}, {sql_top("vendor_name", "named")}
SELECT piid, line_no, supp_no, part_no,
  CASE WHEN agency_name IN (SELECT category FROM agency_name_top) THEN agency_name ELSE 'Unknown' END AS agency,
  CASE WHEN vendor_name IN (SELECT category FROM vendor_name_top) THEN vendor_name ELSE 'Unknown' END AS vendor
FROM named""")
def top_category_mapping(spark, folder):
    rows = awards(spark, folder).select("piid", "line_no", "supp_no", "part_no", "agency", "vendor")
    return FusionModel.fit(rows.select("agency", "vendor"), numeric=[]).map_categories(rows)
