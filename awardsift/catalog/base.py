"""Query registry and the award views over the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import _checkpoint_folder, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under ``name`` or its function's name, with its check."""
    def register(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql is not None:
            ORACLES[key] = sql
        return function
    return register


@lru_cache(maxsize=64)
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A test table; its schema is read once per session. Documents feed text work and are spread if the session says so."""
    scan = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(scan) if name == "documents" else scan


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared folder, for queries that write and read back."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Awards: order lines with their supplier as vendor and its nation as agency.
AWARDS = """awards AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS piid, p_name AS description, l_extendedprice AS value, l_shipdate AS end_date,
         s_name || CASE s_suppkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' LLC' WHEN 2 THEN ' Co.' ELSE '' END AS vendor,
         n_name AS agency, l_linenumber AS line_no, l_suppkey AS supp_no, l_partkey AS part_no,
         l_returnflag AS return_flag, l_discount AS discount, l_tax AS tax, l_quantity AS quantity
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       JOIN part ON l_partkey = p_partkey)"""


def awards(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """The award view; ``heavy`` spreads the order lines over the cores for work that is slow per row."""
    lines, suppliers = table(spark, folder, "lineitem"), table(spark, folder, "supplier")
    lines = spread(lines) if heavy else lines
    nations, parts = table(spark, folder, "nation"), table(spark, folder, "part")
    suffix = (
        F.when(F.col("s_suppkey") % 4 == 0, ", Inc.").when(F.col("s_suppkey") % 4 == 1, " LLC")
        .when(F.col("s_suppkey") % 4 == 2, " Co.").otherwise("")
    )
    joined = (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .join(nations, suppliers.s_nationkey == nations.n_nationkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    return joined.select(
        F.col("l_orderkey").cast("string").alias("piid"), F.col("p_name").alias("description"),
        F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("end_date"),
        F.concat("s_name", suffix).alias("vendor"), F.col("n_name").alias("agency"),
        F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supp_no"), F.col("l_partkey").alias("part_no"),
        F.col("l_returnflag").alias("return_flag"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_quantity").alias("quantity"),
    )


# Scored awards: a score made of price and discount, so that score reports need no model.
SCORED = AWARDS + """, scored AS (
  SELECT *, value AS normalized_value, description AS clean_description,
         value / 100000.0::DOUBLE - discount * 5.0::DOUBLE AS anomaly_score,
         value / 100000.0::DOUBLE - discount * 5.0::DOUBLE >= 0 AS is_anomalous_by_contamination,
         value / 100000.0::DOUBLE - discount * 5.0::DOUBLE > 0.4::DOUBLE AS for_review
  FROM awards)"""


def scored(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    score = F.col("value") / F.lit(100000.0) - F.col("discount") * F.lit(5.0)
    return awards(spark, folder, heavy).withColumns({
        "normalized_value": F.col("value"), "clean_description": F.col("description"), "anomaly_score": score,
        "is_anomalous_by_contamination": score >= 0, "for_review": score > F.lit(0.4),
    })


# Award documents: texts with their source as vendor and their language as agency.
DOCS = """docs AS (
  SELECT CAST(doc_id AS VARCHAR) AS piid, text AS description, n_chars AS value, source AS vendor, lang AS agency, doc_id
  FROM documents)"""


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("piid"), F.col("text").alias("description"), F.col("n_chars").alias("value"),
        F.col("source").alias("vendor"), F.col("lang").alias("agency"), "doc_id",
    )


def labeled_docs(spark: SparkSession, folder: str) -> DataFrame:
    """The labeled set of the text jobs: documents with quality 0."""
    marks = table(spark, folder, "labels").where("quality = 0").select("doc_id")
    return docs(spark, folder).join(marks, "doc_id", "left_semi")


# SQL spellings shared by several checks.
def sql_clean(column: str) -> str:
    return rf"coalesce(trim(regexp_replace(lower({column}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), '')"


def sql_words(clean: str) -> str:
    return f"greatest(len([w FOR w IN string_split({clean}, ' ') IF w <> '']), 1)"


_SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_standardize(column: str) -> str:
    bare = rf"regexp_replace(lower({column}), '[.,]', '', 'g')"
    short = rf"regexp_replace({bare}, '{_SPACE}+(inc|llc|ngo|co)$', '')"
    tidy = rf"trim(regexp_replace({short}, '{_SPACE}+', ' ', 'g'))"
    return f"coalesce(nullif({tidy}, ''), 'Unknown')"


def sql_hash01(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
