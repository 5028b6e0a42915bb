"""Counts, top lists, ranks, samples, splits, unions and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SORT_COLUMN
from ..operators import aggregates as agg
from ..operators import ranks as op
from ..operators.fusion import name_counts
from .base import AWARDS, DOCS, SCORED, awards, docs, query, scored, table
from .joins import SQL_NAMED, sql_top


@query(f"""
WITH {AWARDS}, {SQL_NAMED} SELECT vendor_name AS category, count(*) AS n FROM named WHERE lower(vendor_name) <> 'unknown' GROUP BY 1""")
def category_counts(spark, folder):
    return name_counts(awards(spark, folder), "vendor")


@query(f"WITH {AWARDS}, {SQL_NAMED}, {sql_top('vendor_name', 'named')} SELECT category, n FROM vendor_name_top")
def top_categories(spark, folder):
    return agg.top_categories(name_counts(awards(spark, folder), "vendor"))[0]


@query(f"""
WITH {SCORED} SELECT piid, line_no, supp_no, part_no, round(anomaly_score, 9) AS anomaly_score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, piid) AS rank FROM scored) WHERE rank <= 100""")
def ranked_awards(spark, folder):
    rows = agg.ranked(scored(spark, folder), 100)
    return rows.select("piid", "line_no", "supp_no", "part_no", F.round("anomaly_score", 9).alias("anomaly_score"), "rank")


@query(f"""
WITH {SCORED} SELECT piid, line_no, supp_no, part_no, round(anomaly_score, 9) AS anomaly_score FROM scored ORDER BY 5 DESC, piid""")
def sorted_scores(spark, folder):
    rows = agg.by_score(scored(spark, folder))
    return rows.select("piid", "line_no", "supp_no", "part_no", F.round("anomaly_score", 9).alias("anomaly_score"))


@query(f"""
WITH {SCORED}, best AS (SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, piid) AS rank FROM scored)
SELECT CAST(rank AS INTEGER) AS rank, piid, agency, round(anomaly_score, 9) AS anomaly_score, '$' || format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) || ': ' || description AS label
FROM best WHERE rank <= 20""")
def top_n_awards(spark, folder):
    return agg.top_n(scored(spark, folder)).select("rank", "piid", "agency", F.round("anomaly_score", 9).alias("anomaly_score"), "label")


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200")
def exact_sample(spark, folder):
    return op.exact_sample(table(spark, folder, "documents").select("doc_id"), 200, "doc_id")


@query(f"""
WITH {SCORED}, best AS (SELECT *, row_number() OVER (ORDER BY anomaly_score DESC, piid) AS rank FROM scored)
SELECT CAST(rank AS INTEGER) AS rank, round(anomaly_score, 9) AS anomaly_score, piid, agency, normalized_value FROM best WHERE rank <= 5""")
def top_summary(spark, folder):
    return agg.top_summary(scored(spark, folder)).withColumn("anomaly_score", F.round("anomaly_score", 9))


@query(f"""
WITH {DOCS} SELECT piid, agency FROM (SELECT nullif(piid, '1') AS piid, agency FROM docs)
WHERE piid IS NULL OR piid NOT IN ('Unavailable', 'Charge Card Purchase') ORDER BY md5(concat_ws('|', '42', piid)), piid NULLS FIRST LIMIT 200""")
def fixture_sample(spark, folder):
    rows = docs(spark, folder).select(F.nullif("piid", F.lit("1")).alias("piid"), "agency")
    return op.fixture_sample(rows)


@query("""
SELECT event_id FROM events ORDER BY md5('7|' || event_id), event_id LIMIT 5000""")
def exact_sample_large(spark, folder):
    """The path for samples too large for one task, forced by a small bound."""
    return op.exact_sample(table(spark, folder, "events").select("event_id"), 5000, "event_id", seed=7, small=100)


@query("""
SELECT doc_id, lang, r <= floor(0.8::DOUBLE * n) AS is_train FROM (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM documents)""")
def stratified_split(spark, folder):
    return op.stratified_split(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS piid, lang AS agency, NULL::VARCHAR AS vendor FROM documents
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), NULL, s_name FROM supplier""")
def union_by_name(spark, folder):
    left = docs(spark, folder).select("piid", "agency")
    right = table(spark, folder, "supplier").select(F.col("s_name").alias("vendor"), F.col("s_suppkey").cast("string").alias("piid"))
    return left.unionByName(right, allowMissingColumns=True)


# Orders as API pages: customers are pages, their orders the items; customer 40 is an empty page.
@query("""
WITH pages AS (
  SELECT c_custkey + 1 AS page, CASE WHEN c_custkey = 40 THEN 0 ELSE count(o_orderkey) END AS items
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT page, items FROM pages
WHERE page < coalesce((SELECT min(page) FROM pages WHERE items = 0), 1e9) AND page <= 500 AND page <= 30""")
def page_cutoff(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    sizes = orders.where("o_custkey <> 40").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("c"))
    customers = table(spark, folder, "customer").select("c_custkey")
    pages = customers.join(sizes, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        (F.col("c_custkey") + 1).alias("page"), F.coalesce("c", F.lit(0)).alias("n_items"), F.lit(500).alias("pages"),
    )
    return agg.page_cutoff(pages, 30).select("page", F.col("n_items").alias("items"))


@query("""
SELECT o_orderkey, CAST(ceil(r / 100.0) AS INTEGER) AS page FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 300""")
def newest_first_page(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").alias(SORT_COLUMN["savings"]))
    return agg.page(rows, SORT_COLUMN["savings"], "o_orderkey", size=100, max_pages=3).select("o_orderkey", "page")
