"""Roll-ups, ETL, rates, sweeps and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import main_keywords
from ..functions.keywords import sql_pattern
from ..operators import aggregates as op
from ..operators import scores
from ..plans.etl import award_etl as run_etl
from ..streaming.rollup import current_awards, rollup_stream
from ..session import store
from .base import AWARDS, SCORED, awards, new_folder, query, scored, table

ORDER = ["line_no", "supp_no", "part_no"]
# The whole default list, and words that the part names hold.
_ETL_WORDS = [*main_keywords(), "gear", "anvil"]


def _first(column: str) -> str:
    return f"first({column} ORDER BY line_no, supp_no, part_no) FILTER (WHERE {column} IS NOT NULL) AS {column}"


_ROLLUP = f"""
WITH {AWARDS}, gaps AS (
  SELECT nullif(piid, '5') AS piid, CASE WHEN part_no % 3 > 0 THEN description END AS description, value, end_date,
    CASE WHEN line_no > 1 THEN vendor END AS vendor, CASE WHEN supp_no % 2 = 0 THEN agency END AS agency, line_no, supp_no, part_no FROM awards)
SELECT piid, {_first("description")}, max(value) AS value, strftime(max(end_date), '%Y-%m-%d') AS end_day, {_first("vendor")}, {_first("agency")}
FROM gaps WHERE piid IS NOT NULL GROUP BY piid"""


def _with_gaps(spark, folder):
    return awards(spark, folder, heavy=True).select(
        F.nullif("piid", F.lit("5")).alias("piid"), F.when(F.col("part_no") % 3 > 0, F.col("description")).alias("description"),
        "value", "end_date", F.when(F.col("line_no") > 1, F.col("vendor")).alias("vendor"),
        F.when(F.col("supp_no") % 2 == 0, F.col("agency")).alias("agency"), *ORDER,
    )


@query(_ROLLUP)
def award_rollup(spark, folder):
    rolled = op.rollup_awards(_with_gaps(spark, folder), ["piid"], ORDER)
    return rolled.withColumn("end_day", F.date_format("end_date", "yyyy-MM-dd")).drop("end_date")


@query(_ROLLUP)
def award_rollup_stream(spark, folder):
    """The same from a stream of the rows, in batches of two files, begun anew once."""
    landed, out, state = (new_folder(spark, name) for name in ("landed", "rolled", "state"))
    rows = _with_gaps(spark, folder)
    for part in range(2):
        rows.where(F.pmod(F.xxhash64("piid", *ORDER), F.lit(2)) == part).repartition(4).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(landed)
        rollup_stream(stream, out, state, ["piid"], ORDER).awaitTermination()
    rolled = current_awards(spark, out, ["piid"], ORDER)
    return rolled.withColumn("end_day", F.date_format("end_date", "yyyy-MM-dd")).drop("end_date")


def _raw_dump(spark, folder):
    """The award view as raw dump rows of both types, with text dates, some bad, and fallback columns in use."""
    a, line = awards(spark, folder, heavy=True), F.col("line_no")
    day = F.date_format("end_date", "yyyy-MM-dd")
    contract = F.col("return_flag") != "A"
    return a.select(
        F.when(contract, "contracts").otherwise("grants").alias("award_type"), F.col("agency").alias("department"), *ORDER,
        F.when(contract, F.col("piid")).alias("award_id_piid"), F.when(~contract, F.col("piid")).alias("award_id_fain"),
        F.when(line != 2, F.col("description")).alias("prime_award_base_transaction_description"),
        F.when(line == 2, F.concat(F.col("description"), F.lit(" support"))).alias("award_description"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("current_total_value_of_award"),
        (F.col("value") + 1).cast("decimal(18,2)").cast("string").alias("total_obligated_amount"),
        F.when(line == 3, "not a date").when(line != 4, day).alias("period_of_performance_current_end_date"),
        F.when(line == 4, day).alias("period_of_performance_end_date"),
        F.col("vendor").alias("recipient_name"), F.col("agency").alias("awarding_agency_name"),
    )


@query(f"""
WITH {AWARDS}, standard AS (
  SELECT CASE WHEN return_flag <> 'A' THEN 'contracts' ELSE 'grants' END AS award_type, agency AS department, piid,
    CASE WHEN line_no = 2 THEN description || ' support' ELSE description END AS description,
    CAST(CAST(CASE WHEN return_flag <> 'A' THEN value ELSE value + 1 END AS DECIMAL(18,2)) AS DOUBLE) AS value,
    CASE WHEN line_no <> 3 THEN end_date END AS end_date, vendor, agency, line_no, supp_no, part_no FROM awards)
SELECT award_type, department, piid, {_first("description")}, max(value) AS value, strftime(max(end_date), '%Y-%m-%d') AS end_day,
  {_first("vendor")}, {_first("agency")}
FROM standard WHERE end_date > TIMESTAMP '2000-01-01' AND regexp_matches(description, '{sql_pattern(_ETL_WORDS, "substring")}', 'i')
GROUP BY award_type, department, piid""")
def award_etl(spark, folder):
    rolled = run_etl(_raw_dump(spark, folder), "2000-01-01", _ETL_WORDS, order=ORDER)
    return rolled.withColumn("end_day", F.date_format("end_date", "yyyy-MM-dd")).drop("end_date")


@query(f"""
WITH {SCORED} SELECT agency, anomaly_count, total_count, round(100.0::DOUBLE * anomaly_count / total_count, 6) AS anomaly_percentage FROM (
  SELECT agency, count(*) FILTER (WHERE for_review) AS anomaly_count, count(for_review) AS total_count FROM scored GROUP BY agency)
ORDER BY 100.0::DOUBLE * anomaly_count / total_count DESC, agency LIMIT 15""")
def agency_review_rate(spark, folder):
    return op.agency_rates(scored(spark, folder)).withColumn("anomaly_percentage", F.round("anomaly_percentage", 6))


@query(f"""
WITH {SCORED} SELECT count(*) AS total, count(*) FILTER (WHERE is_anomalous_by_contamination) AS flagged_by_contamination,
  count(*) FILTER (WHERE for_review) AS flagged_for_review,
  round(count(*) FILTER (WHERE for_review) / CAST(count(*) AS DOUBLE), 9) AS review_rate FROM scored""")
def run_counts(spark, folder):
    return op.run_counts(scored(spark, folder)).withColumn("review_rate", F.round("review_rate", 9))


@query(f"""
WITH {AWARDS}, outputs AS (
  SELECT DISTINCT agency AS department, CASE WHEN return_flag <> 'A' THEN 'contracts' ELSE 'grants' END AS award_type,
    CASE WHEN supp_no % 5 = 0 THEN '' ELSE 'out/' || agency END AS path FROM awards)
SELECT department, max(path) FILTER (WHERE award_type = 'contracts') AS contracts, max(path) FILTER (WHERE award_type = 'grants') AS grants
FROM outputs WHERE path <> '' GROUP BY department""")
def run_summary_map(spark, folder):
    outputs = awards(spark, folder).select(
        F.col("agency").alias("department"), F.when(F.col("return_flag") != "A", "contracts").otherwise("grants").alias("award_type"),
        F.when(F.col("supp_no") % 5 == 0, "").otherwise(F.concat(F.lit("out/"), "agency")).alias("path"),
    )
    paths = op.run_summary(outputs)
    return paths.select("department", F.try_element_at("paths", F.lit("contracts")).alias("contracts"), F.try_element_at("paths", F.lit("grants")).alias("grants"))


@query(f"WITH {SCORED} SELECT min(anomaly_score) AS min_score, max(anomaly_score) AS max_score FROM scored")
def score_range(spark, folder):
    return op.score_range(scored(spark, folder))


@query(f"""
WITH {SCORED}, ends AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi FROM scored),
grid AS (SELECT i, CASE WHEN i = 49 THEN hi ELSE lo + i * ((hi - lo) / 49.0::DOUBLE) END AS threshold FROM ends, range(50) r(i))
SELECT CAST(i AS INTEGER) AS step, round(threshold, 9) AS threshold, count(*) FILTER (WHERE anomaly_score > threshold) AS flagged
FROM grid, scored GROUP BY i, threshold""")
def threshold_sweep(spark, folder):
    return op.sweep(scored(spark, folder)).withColumn("threshold", F.round("threshold", 9))


_TRUTH = f"{SCORED}, judged AS (SELECT *, CASE WHEN return_flag = 'R' THEN -1 ELSE 1 END AS y_true, CASE WHEN for_review THEN -1 ELSE 1 END AS y_pred FROM scored)"


def _judged(spark, folder):
    return scored(spark, folder).withColumns({
        "y_true": F.when(F.col("return_flag") == "R", -1).otherwise(1), "y_pred": F.when(F.col("for_review"), -1).otherwise(1),
    })


def _sql_metrics(hit: str, predicted: str, real: str) -> str:
    return f"""round(coalesce({hit} / nullif({predicted}, 0)::DOUBLE, 0), 9) AS precision,
  round(coalesce({hit} / nullif({real}, 0)::DOUBLE, 0), 9) AS recall,
  round(coalesce(2 * {hit} / nullif({predicted} + {real}, 0)::DOUBLE, 0), 9) AS f1_score"""


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1_score")})


@query(f"""
WITH {_TRUTH}, c AS (SELECT count(*) FILTER (WHERE y_true = -1 AND y_pred = -1) AS hit, count(*) FILTER (WHERE y_pred = -1) AS p,
  count(*) FILTER (WHERE y_true = -1) AS r FROM judged)
SELECT {_sql_metrics("hit", "p", "r")} FROM c""")
def evaluate_flags(spark, folder):
    return _rounded(op.evaluate(_judged(spark, folder), "y_true", "y_pred"))


@query(f"""
WITH {_TRUTH}, c AS (
  SELECT t AS threshold, count(*) FILTER (WHERE y_true = -1 AND anomaly_score > t) AS hit, count(*) FILTER (WHERE anomaly_score > t) AS p,
    count(*) FILTER (WHERE y_true = -1) AS r
  FROM judged, (VALUES (-0.2::DOUBLE), (0.0::DOUBLE), (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE), (9.0::DOUBLE)) v(t) GROUP BY t)
SELECT threshold, {_sql_metrics("hit", "p", "r")} FROM c""")
def threshold_metrics(spark, folder):
    return _rounded(op.threshold_metrics(_judged(spark, folder), "anomaly_score", "y_true", [-0.2, 0.0, 0.1, 0.3, 0.5, 9.0]))


@query(f"""
WITH {SCORED}, ends AS (SELECT min(anomaly_score) AS lo, (max(anomaly_score) - min(anomaly_score)) / 30.0::DOUBLE AS w, max(anomaly_score) AS hi FROM scored),
counts AS (SELECT CAST(least(floor((anomaly_score - lo) * 30 / (hi - lo)), 29) AS INTEGER) AS bin, count(*) AS n FROM scored, ends GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * w, 9) AS bin_start, round(lo + (i + 1) * w, 9) AS bin_end, coalesce(n, 0) AS n
FROM ends, range(30) r(i) LEFT JOIN counts ON counts.bin = i""")
def score_histogram(spark, folder):
    bins = op.histogram(scored(spark, folder), "anomaly_score", 30)
    return bins.withColumns({c: F.round(c, 9) for c in ("bin_start", "bin_end")})


@query(f"""
WITH {SCORED}, s AS (SELECT min(anomaly_score) AS lo, max(anomaly_score) AS hi, count(*)::DOUBLE AS n,
  stddev_samp(anomaly_score) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h FROM scored),
grid AS (SELECT i, lo + i * ((hi - lo) / 199.0::DOUBLE) AS point, n, h FROM s, range(200) r(i))
SELECT CAST(i AS INTEGER) AS i, round(point, 9) AS point,
  round(sum(exp(-0.5::DOUBLE * pow((point - anomaly_score) / h, 2))) / (max(n) * max(h) * sqrt(2 * pi())), 8) AS density
FROM grid, scored GROUP BY i, point""")
def score_density(spark, folder):
    points = op.density(scored(spark, folder, heavy=True), "anomaly_score", 200)
    return points.withColumns({"point": F.round("point", 9), "density": F.round("density", 8)})


def _sql_place(x: str, low: str, high: str) -> str:
    return f"CAST(least(floor(({x} - {low}) * 20 / ({high} - {low})), 19) AS INTEGER)"


@query(f"""
WITH {SCORED}, e AS (SELECT min(anomaly_score) AS s0, max(anomaly_score) AS s1, ln(min(value)) AS v0, ln(max(value)) AS v1 FROM scored)
SELECT {_sql_place("anomaly_score", "s0", "s1")} AS score_bin, {_sql_place("ln(value)", "v0", "v1")} AS value_bin, for_review,
  count(*) AS n, true AS log_scale FROM scored, e GROUP BY 1, 2, 3""")
def value_score_grid(spark, folder):
    return op.value_score_grid(scored(spark, folder))


_WORDS = main_keywords()


@query("WITH words(keyword) AS (VALUES " + ", ".join(f"('{w}')" for w in sorted({w for w in _WORDS})) + """)
SELECT keyword, count(doc_id) AS documents FROM words LEFT JOIN documents ON contains(lower(text), lower(keyword)) GROUP BY keyword""")
def keyword_union(spark, folder):
    """Documents per keyword of the distinct union of all lists."""
    words = spark.createDataFrame([(w,) for w in _WORDS], "keyword string").distinct()
    literal = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(w.lower()).alias("low")) for w in _WORDS])
    texts = table(spark, folder, "documents").select(F.lower("text").alias("text"))
    hits = texts.select(F.explode(F.filter(literal, lambda w: F.contains(F.col("text"), w["low"]))["word"]).alias("keyword"))
    counts = hits.groupBy("keyword").agg(F.count(F.lit(1)).alias("documents"))
    zero = words.select("keyword", F.lit(0).cast("bigint").alias("documents"))
    return counts.union(zero).groupBy("keyword").agg(F.sum("documents").alias("documents"))


_SHARES = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query(f"""
WITH {SCORED}, shares AS (SELECT unnest({_SHARES}::DOUBLE[]) AS share, unnest((SELECT quantile_cont(anomaly_score, {_SHARES}::DOUBLE[]) FROM scored)) AS score)
SELECT share, round(score, 9) AS score, true AS estimate_holds, (SELECT count(*) FROM scored WHERE anomaly_score IS NOT NULL) AS n FROM shares""")
def score_percentiles(spark, folder):
    """Summaries of batches of awards (by line number), stored and merged; exact percentiles refined from the merged one.

    ``estimate_holds``: the merged sketch's own estimate lies within three times its stated rank error of the share.
    """
    rows = store(scored(spark, folder).select("line_no", "anomaly_score"))
    whole = store(scores.merge(store(scores.summarise(rows, "anomaly_score", ["line_no"]))))
    exact = scores.percentiles(rows, "anomaly_score", _SHARES, whole)
    rough = {r["share"]: r["estimate"] for r in scores.estimate(whole, _SHARES).collect()}
    x, slack, checks = F.col("anomaly_score"), 3 * scores.rank_error(), []
    for share, value in zip(_SHARES, exact):
        below, upto = (F.count_if(c) / F.count(x) for c in (x < rough[share], x <= rough[share]))
        holds = (below - slack <= share) & (upto + slack >= share)
        checks.append(F.struct(F.lit(share).alias("share"), F.round(F.lit(value), 9).alias("score"), holds.alias("estimate_holds"), F.count(x).alias("n")))
    return rows.agg(F.array(*checks).alias("found")).select(F.inline("found"))
