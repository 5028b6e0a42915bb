"""Filters and scalar predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import main_keywords
from ..functions.keywords import sql_pattern
from ..operators import filters as op
from ..operators.schema_ops import review_projection
from .base import AWARDS, SCORED, awards, query, scored, table

PART_WORDS = ["hot", "gear", "anvil"]


@query("""
SELECT doc_id, piid FROM (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Unavailable' WHEN doc_id % 11 = 0 THEN 'Charge Card Purchase'
                      WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(doc_id AS VARCHAR) END AS piid FROM documents)
WHERE piid IS NULL OR piid NOT IN ('Unavailable', 'Charge Card Purchase')""")
def placeholder_filter(spark, folder):
    key = F.col("doc_id")
    piid = (
        F.when(key % 7 == 0, "Unavailable").when(key % 11 == 0, "Charge Card Purchase")
        .when(key % 13 == 0, F.lit(None)).otherwise(key.cast("string"))
    )
    return op.drop_placeholders(table(spark, folder, "documents").select("doc_id", piid.alias("piid")))


@query(f"""
WITH {AWARDS} SELECT piid, line_no, supp_no, part_no, value, strftime(end_date, '%Y-%m-%d') AS end_day
FROM awards WHERE end_date > TIMESTAMP '2000-01-01'""")
def active_awards(spark, folder):
    kept = op.active(awards(spark, folder), "2000-01-01")
    return kept.select("piid", "line_no", "supp_no", "part_no", "value", F.date_format("end_date", "yyyy-MM-dd").alias("end_day"))


@query(f"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '{sql_pattern(main_keywords(), "substring")}', 'i')""")
def keyword_substring(spark, folder):
    return op.keyword_match(table(spark, folder, "documents"), "text", main_keywords()).select("doc_id")


@query(f"""
WITH {AWARDS} SELECT piid, line_no, supp_no, part_no, description FROM awards
WHERE regexp_matches(description, '{sql_pattern(PART_WORDS, "whole_word")}', 'i')""")
def keyword_whole_word(spark, folder):
    hits = op.keyword_match(awards(spark, folder), "description", PART_WORDS, "whole_word")
    return hits.select("piid", "line_no", "supp_no", "part_no", "description")


@query(f"""
SELECT doc_id FROM documents WHERE regexp_matches(text, '{sql_pattern(["of", "le", "der", "el"], "whole_word")}', 'i')""")
def keyword_whole_word_documents(spark, folder):
    return op.keyword_match(table(spark, folder, "documents"), "text", ["of", "le", "der", "el"], "whole_word").select("doc_id")


@query(f"WITH {AWARDS} SELECT piid, line_no, supp_no, part_no, agency FROM awards WHERE contains(lower(agency), 'nation_1')")
def department_filter(spark, folder):
    return op.department(awards(spark, folder), "Nation_1").select("piid", "line_no", "supp_no", "part_no", "agency")


@query(f"""
WITH {AWARDS}, coded AS (
  SELECT *, CASE line_no WHEN 1 THEN 'A' WHEN 2 THEN 'IDV_B_A' WHEN 3 THEN '02' WHEN 4 THEN '05' ELSE 'X' END AS award_type_code
  FROM awards)
SELECT piid, line_no, supp_no, part_no, award_type_code FROM coded
WHERE award_type_code IN ('A','B','C','D','IDV_A','IDV_B','IDV_B_A','IDV_B_B','IDV_B_C','IDV_C','IDV_D','IDV_E')
  AND agency = 'NATION_3' AND CAST(end_date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""")
def awards_by_selection(spark, folder):
    line = F.col("line_no")
    code = F.when(line == 1, "A").when(line == 2, "IDV_B_A").when(line == 3, "02").when(line == 4, "05").otherwise("X")
    coded = awards(spark, folder).withColumns({"award_type_code": code, "action_date": F.col("end_date")})
    kept = op.select_awards(coded, "contracts", "NATION_3", "1997-01-01", "1999-12-31")
    return kept.select("piid", "line_no", "supp_no", "part_no", "award_type_code")


@query(f"""
WITH {SCORED} SELECT piid, description, value, vendor, agency, strftime(end_date, '%Y-%m-%d') AS end_date,
  round(anomaly_score, 9) AS anomaly_score, for_review FROM scored WHERE for_review""")
def review_only(spark, folder):
    rows = review_projection(scored(spark, folder))
    return rows.withColumns({"end_date": F.date_format("end_date", "yyyy-MM-dd"), "anomaly_score": F.round("anomaly_score", 9)})


@query(f"""
WITH {AWARDS} SELECT agency, count(*) FILTER (WHERE v IS NOT NULL AND lower(v) <> 'unknown' AND v <> 'Unavailable') AS named, count(*) AS total
FROM (SELECT agency, CASE supp_no % 6 WHEN 0 THEN 'Unavailable' WHEN 1 THEN NULL WHEN 2 THEN 'UNKNOWN' ELSE vendor END AS v FROM awards)
GROUP BY agency""")
def vendor_validity(spark, folder):
    case = F.col("supp_no") % 6
    vendor = F.when(case == 0, "Unavailable").when(case == 1, F.lit(None)).when(case == 2, "UNKNOWN").otherwise(F.col("vendor"))
    rows = awards(spark, folder).select("agency", op.valid_vendor(vendor).alias("valid"))
    return rows.groupBy("agency").agg(F.count_if("valid").alias("named"), F.count(F.lit(1)).alias("total"))


@query(f"""
WITH {AWARDS} SELECT 'active' AS step, count(*) AS rows_in, count(*) FILTER (WHERE end_date > TIMESTAMP '2000-01-01') AS rows_out
FROM awards""")
def rows_removed(spark, folder):
    rows = awards(spark, folder).select("end_date")
    kept = op.is_active(dict(rows.dtypes)["end_date"], "2000-01-01")
    return rows.agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(kept).alias("rows_out")).select(F.lit("active").alias("step"), "rows_in", "rows_out")
