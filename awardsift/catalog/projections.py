"""Renames, fallbacks, fills and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean_text, money, normalize_value, run_stamp, slug, standardize_name, truncate, vendor_or_unknown
from ..operators import schema_ops as op
from ..plans.prepare import prepare_labeled, prepare_unlabeled
from .base import AWARDS, DOCS, awards, docs, labeled_docs, query, sql_clean, sql_standardize, sql_words, table

KEYS = ["piid", "line_no", "supp_no", "part_no"]


def _raw(spark, folder):
    """The award view under raw dump names; contract and grant columns side by side."""
    a = awards(spark, folder)
    return a.select(
        *KEYS, F.concat(F.lit("C"), "piid").alias("award_id_piid"), F.concat(F.lit("G"), "piid").alias("award_id_fain"),
        F.col("description").alias("prime_award_base_transaction_description"), F.col("value").alias("current_total_value_of_award"),
        (F.col("value") * 2).alias("total_obligated_amount"), F.col("vendor").alias("recipient_name"),
        F.col("agency").alias("awarding_agency_name"),
    )


@query(f"""
WITH {AWARDS} SELECT 'C' || piid AS piid, description, value, vendor, agency, CAST(NULL AS VARCHAR) AS end_date FROM awards""")
def rename_contracts(spark, folder):
    return op.map_columns(_raw(spark, folder).drop("piid"), "contracts")


@query(f"""
WITH {AWARDS} SELECT 'G' || piid AS piid, description, value * 2 AS value, vendor, agency, CAST(NULL AS VARCHAR) AS end_date FROM awards""")
def rename_grants(spark, folder):
    return op.map_columns(_raw(spark, folder).drop("piid"), "grants")


@query("SELECT doc_id, lang AS agency, CAST(NULL AS VARCHAR) AS vendor, CAST(NULL AS DOUBLE) AS normalized_value FROM documents")
def ensure_columns(spark, folder):
    base = table(spark, folder, "documents").select("doc_id", F.col("lang").alias("agency"))
    return op.ensure_columns(base, {"agency": "string", "vendor": "string", "normalized_value": "double"})


@query(f"""
WITH {DOCS} SELECT 'labeled' AS side, docs.piid, description, value, vendor, agency FROM docs JOIN labels USING (doc_id) WHERE quality = 0
UNION ALL SELECT 'unlabeled', piid, description, value, vendor, CAST(NULL AS VARCHAR) FROM docs""")
def align_columns(spark, folder):
    left = labeled_docs(spark, folder).withColumn("savings", F.lit(0)).drop("doc_id")
    right = docs(spark, folder).drop("agency").withColumn("end_date", F.lit("x"))
    a, b = op.align(left, right)
    return a.withColumn("side", F.lit("labeled")).unionByName(b.withColumn("side", F.lit("unlabeled")))


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
  coalesce(CASE WHEN l_linenumber <> 1 THEN strftime(l_shipdate, '%Y-%m-%d') END,
           CASE WHEN l_partkey % 2 = 0 THEN strftime(l_shipdate, '%Y-%m') || '-28' END) AS end_day
FROM lineitem""")
def date_fallback(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey",
        F.when(F.col("l_linenumber") != 1, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("period_of_performance_current_end_date"),
        F.when(F.col("l_partkey") % 2 == 0, F.concat(F.date_format("l_shipdate", "yyyy-MM"), F.lit("-28"))).alias("period_of_performance_end_date"),
    )
    resolved = op.end_date_fallback(lines, "end_day")
    return resolved.drop("period_of_performance_current_end_date", "period_of_performance_end_date")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_name END, CASE WHEN p_size > 10 THEN p_brand END, p_type) AS text
FROM part""")
def description_fallback(spark, folder):
    parts = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("prime_award_base_transaction_description"),
        F.when(F.col("p_size") > 10, F.col("p_brand")).alias("award_description"),
        F.col("p_type").alias("prime_award_project_description"),
    )
    return op.description_fallback(parts, "text").select("p_partkey", "text")


@query(f"""
WITH {DOCS} SELECT doc_id, coalesce(nullif(agency, 'fr'), 'Unknown') AS agency, coalesce(nullif(vendor, 'src3'), 'Unknown') AS vendor,
  '' AS clean_description, coalesce(CASE WHEN value > 1000 THEN CAST(value AS DOUBLE) END, 0.0::DOUBLE) AS normalized_value FROM docs""")
def fill_nulls(spark, folder):
    rows = docs(spark, folder).select(
        "doc_id", F.nullif("agency", F.lit("fr")).alias("agency"), F.nullif("vendor", F.lit("src3")).alias("vendor"),
        F.lit(None).cast("string").alias("clean_description"),
        F.when(F.col("value") > 1000, F.col("value").cast("double")).alias("normalized_value"),
    )
    return op.fill_nulls(rows)


@query(f"""
WITH {AWARDS} SELECT piid, line_no, supp_no, part_no,
  coalesce(CASE WHEN line_no > 1 THEN value END, 0.0::DOUBLE) AS normalized_value, value / 4.0::DOUBLE AS value_per_word FROM awards""")
def numeric_features(spark, folder):
    rows = awards(spark, folder).withColumns({
        "normalized_value": F.when(F.col("line_no") > 1, F.col("value")), "value_per_word": F.col("value") / F.lit(4.0),
    })
    return op.numeric_features(rows, ["normalized_value", "value_per_word", "absent"], KEYS)


@query(f"WITH {AWARDS} SELECT piid, line_no, supp_no, part_no, agency, vendor FROM awards")
def categorical_features(spark, folder):
    return op.categorical_features(awards(spark, folder), ["agency", "vendor"], KEYS)


@query(f"SELECT doc_id, {sql_clean('text')} AS clean_description FROM documents", name="clean_text")
def clean_texts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", clean_text(F.col("text")).alias("clean_description"))


@query(f"SELECT conv_id, turn, {sql_clean('text')} AS clean_description FROM conversations")
def clean_conversations(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", clean_text(F.col("text")).alias("clean_description"))


@query(r"""
WITH priced AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS dec FROM lineitem),
texts AS (SELECT *, CASE l_linenumber WHEN 1 THEN '$' || dec WHEN 2 THEN ' ' || substr(dec, 1, 1) || ',' || substr(dec, 2) || ' '
  WHEN 3 THEN dec || 'd' WHEN 4 THEN '-' || dec || 'e-2' WHEN 5 THEN 'n/a' WHEN 6 THEN NULL ELSE dec END AS value FROM priced)
SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, value,
  CASE WHEN regexp_full_match(replace(replace(value, '$', ''), ',', ''), '\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*')
       THEN CAST(trim(replace(replace(value, '$', ''), ',', '')) AS DOUBLE) ELSE 0.0::DOUBLE END AS normalized_value
FROM texts""", name="normalize_value")
def normalized_values(spark, folder):
    dec = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    line = F.col("l_linenumber")
    text = (
        F.when(line == 1, F.concat(F.lit("$"), dec))
        .when(line == 2, F.concat(F.lit(" "), F.substring(dec, 1, 1), F.lit(","), F.substring(dec, 2, 30), F.lit(" ")))
        .when(line == 3, F.concat(dec, F.lit("d"))).when(line == 4, F.concat(F.lit("-"), dec, F.lit("e-2")))
        .when(line == 5, "n/a").when(line == 6, F.lit(None)).otherwise(dec)
    )
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", text.alias("value"))
    return rows.withColumn("normalized_value", normalize_value(F.col("value")))


@query(f"""
WITH {DOCS} SELECT doc_id, {sql_words(sql_clean('description'))} AS words,
  round(CAST(value AS DOUBLE) / {sql_words(sql_clean('description'))}, 9) AS value_per_word FROM docs""", name="value_per_word")
def values_per_word(spark, folder):
    from ..functions import value_per_word, word_count

    clean = clean_text(F.col("description"))
    return docs(spark, folder).withColumn("clean", clean).select(
        "doc_id", F.greatest(word_count(F.col("clean")), F.lit(1)).cast("bigint").alias("words"),
        F.round(value_per_word(F.col("value").cast("double"), F.col("clean")), 9).alias("value_per_word"),
    )


@query(f"""
WITH {AWARDS} SELECT piid, line_no, supp_no, part_no, {sql_standardize("vendor || CASE line_no WHEN 1 THEN ' ' WHEN 2 THEN ' INC' ELSE '' END")} AS name
FROM awards""", name="standardize_name")
def standardized_names(spark, folder):
    tail = F.when(F.col("line_no") == 1, " ").when(F.col("line_no") == 2, " INC").otherwise("")
    return awards(spark, folder).select(*KEYS, standardize_name(F.concat("vendor", tail)).alias("name"))


@query("""
SELECT doc_id, CASE WHEN vendor IS NULL OR vendor IN ('Unavailable', 'DOMESTIC AWARDEES (UNDISCLOSED)') THEN 'Unknown' ELSE vendor END AS vendor
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'DOMESTIC AWARDEES (UNDISCLOSED)' WHEN 2 THEN NULL ELSE source END AS vendor
      FROM documents)""")
def vendor_placeholders(spark, folder):
    key = F.col("doc_id") % 5
    raw = F.when(key == 0, "Unavailable").when(key == 1, "DOMESTIC AWARDEES (UNDISCLOSED)").when(key == 2, F.lit(None)).otherwise(F.col("source"))
    return table(spark, folder, "documents").select("doc_id", vendor_or_unknown(raw).alias("vendor"))


@query(f"""
WITH {DOCS} SELECT doc_id, CASE WHEN length(description) > 50 THEN substr(description, 1, 47) || '...' ELSE description END AS short_text,
  '$' || format('{{:,}}', value) AS money FROM docs""")
def display_labels(spark, folder):
    return docs(spark, folder).select(
        "doc_id", truncate(F.col("description")).alias("short_text"), money(F.col("value").cast("double")).alias("money")
    )


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS slug FROM part")
def slug_names(spark, folder):
    return table(spark, folder, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


@query("SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def run_stamps(spark, folder):
    return table(spark, folder, "events").select("event_id", run_stamp(F.col("ts")).alias("stamp"))


_CLEAN = sql_clean("description")
_PREPARED = f"""coalesce(nullif(agency, 'de'), 'Unknown') AS agency, vendor, value, {_CLEAN} AS clean_description,
  CAST(value AS DOUBLE) AS normalized_value, round(CAST(value AS DOUBLE) / {sql_words(_CLEAN)}, 9) AS value_per_word"""


def _nulled(df):
    return df.withColumn("agency", F.nullif("agency", F.lit("de")))


@query(f"""
WITH {DOCS} SELECT docs.piid, {_PREPARED}, true AS is_canceled FROM docs JOIN labels USING (doc_id) WHERE quality = 0""", name="prepare_labeled")
def prepared_labeled(spark, folder):
    rows = prepare_labeled(_nulled(labeled_docs(spark, folder)).drop("doc_id"))
    return rows.drop("description").withColumn("value_per_word", F.round("value_per_word", 9))


@query(f"""
WITH {DOCS} SELECT piid, {_PREPARED} FROM docs
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)""", name="prepare_unlabeled")
def prepared_unlabeled(spark, folder):
    ids = labeled_docs(spark, folder).select("piid").distinct()
    rows = prepare_unlabeled(_nulled(docs(spark, folder)).drop("doc_id"), ids)
    return rows.drop("description").withColumn("value_per_word", F.round("value_per_word", 9))
