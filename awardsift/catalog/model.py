"""Isolation forest: fixed trees against SQL, offsets and thresholds, fit, score and explanation."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from .. import schema
from ..operators import aggregates as agg
from ..operators import analysis
from ..operators import forest as op
from ..operators.explain import importance
from ..operators.explain import shap_summary as summary
from ..operators.explain import shap_values as explain
from ..operators.ranks import percentile
from ..operators.vectors import dense
from ..plans.prepare import prepare_labeled
from ..plans.similarity import AwardModel
from ..session import checkpoint
from .base import SCORED, awards, docs, labeled_docs, query, scored, table

# A small forest over the 64 embedding columns: tree, node, leaf, feature, split, left, right, depth, rows, path length.
SMALL_FOREST = [
    (0, 0, False, 3, 0.01, 1, 2, 0, 16, 0.0), (0, 1, False, 10, -0.05, 3, 4, 1, 7, 0.0), (0, 2, True, -1, 0.0, -1, -1, 1, 9, 1 + op.average_path(9)),
    (0, 3, True, -1, 0.0, -1, -1, 2, 1, 2.0), (0, 4, True, -1, 0.0, -1, -1, 2, 6, 2 + op.average_path(6)),
    (1, 0, False, 40, 0.08, 1, 2, 0, 16, 0.0), (1, 1, False, 3, -0.11, 3, 4, 1, 12, 0.0), (1, 2, True, -1, 0.0, -1, -1, 1, 4, 1 + op.average_path(4)),
    (1, 3, True, -1, 0.0, -1, -1, 2, 3, 2 + op.average_path(3)), (1, 4, False, 63, 0.2, 5, 6, 2, 9, 0.0),
    (1, 5, True, -1, 0.0, -1, -1, 3, 8, 3 + op.average_path(8)), (1, 6, True, -1, 0.0, -1, -1, 3, 1, 3.0),
    (2, 0, True, -1, 0.0, -1, -1, 0, 16, op.average_path(16)),
]
_NODES = "nodes(tree_id, node_id, is_leaf, feature, split, l, r, depth, n, path_len) AS (VALUES " + ", ".join(
    f"({t}, {n}, {str(leaf).lower()}, {f}, {s}::DOUBLE, {a}, {b}, {d}, {c}, {p!r}::DOUBLE)" for t, n, leaf, f, s, a, b, d, c, p in SMALL_FOREST
) + ")"
_STEP = """
  SELECT w.vec_id, w.tree_id, CASE WHEN k.is_leaf THEN w.node_id WHEN e.embedding[k.feature + 1] <= k.split THEN k.l ELSE k.r END AS node_id
  FROM {source} w JOIN nodes k USING (tree_id, node_id) JOIN embeddings e USING (vec_id)"""
SQL_FOREST = f"""{_NODES}, step0 AS (SELECT vec_id, tree_id, 0 AS node_id FROM embeddings, (SELECT DISTINCT tree_id FROM nodes)),
step1 AS ({_STEP.format(source="step0")}), step2 AS ({_STEP.format(source="step1")}), step3 AS ({_STEP.format(source="step2")}),
raw AS (SELECT vec_id, -pow(2.0::DOUBLE, -avg(path_len) / {op.average_path(16)!r}::DOUBLE) AS raw
  FROM step3 JOIN nodes USING (tree_id, node_id) GROUP BY vec_id)"""


@query(f"WITH {SQL_FOREST} SELECT vec_id, round(raw, 9) AS raw FROM raw")
def forest_score_fixed(spark, folder):
    """The real scorer on a hand-made forest; the check walks the trees with joins."""
    arrays = op.ForestArrays.collect(spark.createDataFrame(SMALL_FOREST, schema.FOREST))
    rows = table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    path = op.mean_path_length(spark, arrays, F.col("features"))
    return rows.select("vec_id", F.round(op.score_from_path(path, 16), 9).alias("raw"))


@query(f"WITH {SQL_FOREST} SELECT vec_id, round(raw, 9) AS raw FROM raw")
def forest_score_columns(spark, folder):
    """The same scores from column functions alone: the plan holds no Python worker."""
    arrays = op.ForestArrays.collect(spark.createDataFrame(SMALL_FOREST, schema.FOREST))
    rows = table(spark, folder, "embeddings").select("vec_id", dense(F.col("embedding")).alias("features"))
    walked = op.with_mean_path(rows, arrays, F.col("features"), "path")
    return walked.select("vec_id", F.round(op.score_from_path(F.col("path"), 16), 9).alias("raw"))


# Every leaf of the small forest with the conditions on its path: tree, leaf, path length; and per condition the feature, the split,
# whether it is the left side, and the share of the sample that went there.
def _leaves() -> tuple[list[tuple], list[tuple]]:
    nodes = {(row[0], row[1]): row for row in SMALL_FOREST}
    leaves, conditions, todo = [], [], [(tree, 0, ()) for tree in sorted({row[0] for row in SMALL_FOREST})]
    while todo:
        tree, node, path = todo.pop()
        _, _, leaf, feature, split, left, right, _, cover, length = nodes[tree, node]
        if leaf:
            leaves.append((tree, node, length))
            conditions += [(tree, node, *step) for step in path]
            continue
        for child, is_left in ((left, True), (right, False)):
            todo.append((tree, child, (*path, (feature, split, is_left, nodes[tree, child][8] / cover))))
    return leaves, conditions


_LEAVES, _CONDITIONS = _leaves()
_SPLIT_ON = sorted({row[2] for row in _CONDITIONS})
_SHARES = {k: math.factorial(k) * math.factorial(len(_SPLIT_ON) - k - 1) / math.factorial(len(_SPLIT_ON)) for k in range(len(_SPLIT_ON))}


@query(f"""
WITH leaves(tree, leaf, length) AS (VALUES {", ".join(f"({t}, {n}, {v!r}::DOUBLE)" for t, n, v in _LEAVES)}),
conditions(tree, leaf, feature, split, is_left, share) AS (VALUES {", ".join(f"({t}, {n}, {f}, {s}::DOUBLE, {str(c).lower()}, {p!r}::DOUBLE)" for t, n, f, s, c, p in _CONDITIONS)}),
features(feature, bit) AS (VALUES {", ".join(f"({f}, {1 << i})" for i, f in enumerate(_SPLIT_ON))}),
sets AS (SELECT s FROM range({1 << len(_SPLIT_ON)}) t(s)),
weights AS (
  SELECT vec_id, s, tree, leaf, any_value(length) AS length,
    product(CASE WHEN c.feature IS NULL THEN 1 WHEN s & bit = 0 THEN share WHEN (embedding[c.feature + 1] <= split) = is_left THEN 1 ELSE 0 END) AS w
  FROM embeddings, sets, leaves LEFT JOIN conditions c USING (tree, leaf) LEFT JOIN features USING (feature) GROUP BY ALL),
worth AS (SELECT vec_id, s, sum(w * length) / 3.0::DOUBLE AS v FROM weights GROUP BY ALL)
SELECT a.vec_id, CAST(feature AS INTEGER) AS feature, round(sum((b.v - a.v) * CASE bit_count(a.s) {" ".join(f"WHEN {k} THEN {v!r}::DOUBLE" for k, v in _SHARES.items())} END), 9) AS phi
FROM worth a, features JOIN worth b ON b.vec_id = a.vec_id AND b.s = a.s + bit WHERE a.s & bit = 0 GROUP BY ALL""")
def shap_fixed(spark, folder):
    """Shapley values on the hand-made forest; the check goes through all sets of features."""
    nodes = spark.createDataFrame(SMALL_FOREST, schema.FOREST)
    model = op.IsolationForestModel(nodes, 16, 0.0, 0.0, op.ForestArrays.collect(nodes))
    names = spark.range(64).select(F.col("id").cast("int").alias("feature"), F.concat(F.lit("f"), "id").alias("name"))
    rows = table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return explain(model, rows, names, "vec_id").select("vec_id", "feature", F.round("phi", 9).alias("phi"))


# The fit itself in SQL: draws, splits and levels from the md5 of seed, tree, row and node.
TREES, SAMPLES, SEED = 100, op.MAX_SAMPLES, 42
LEVELS = 8


def _sql_fraction(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def _sql_level(k: int) -> str:
    return f"""
r{k} AS MATERIALIZED (SELECT tree, node, f, min(x) AS lo, max(x) AS hi, count(*) AS c FROM m{k} JOIN cells USING (vec_id) GROUP BY ALL),
v{k} AS (SELECT tree, node, any_value(c) AS c, list({{'f': f, 'lo': lo, 'hi': hi}} ORDER BY f) FILTER (hi > lo + {op.FLAT!r}::DOUBLE) AS v FROM r{k} GROUP BY tree, node),
p{k} AS (SELECT tree, node, c, CASE WHEN {k} < deepest AND c >= 2 THEN
    v[1 + CAST(floor({_sql_fraction(str(SEED), "tree", "node", "'feature'")} * len(v)) AS INTEGER)] END AS p FROM v{k}, size),
n{k} AS MATERIALIZED (SELECT tree, node, {k} AS depth, c, p IS NULL AS is_leaf, coalesce(p.f, -1) AS f,
    CASE WHEN p IS NULL THEN 0 WHEN s >= p.hi THEN p.lo ELSE s END AS split
  FROM (SELECT *, p.lo + {_sql_fraction(str(SEED), "tree", "node", "'split'")} * (p.hi - p.lo) AS s FROM p{k})),
m{k + 1} AS MATERIALIZED (SELECT tree, vec_id, CASE WHEN x <= split THEN 2 * node + 1 ELSE 2 * node + 2 END AS node
  FROM m{k} JOIN n{k} USING (tree, node) JOIN cells USING (vec_id, f) WHERE NOT is_leaf)"""


SQL_FIT = f"""
size AS (SELECT least({SAMPLES}, count(*)) AS s, ceil(log2(greatest(2, least({SAMPLES}, count(*))))) AS deepest FROM embeddings),
cells AS MATERIALIZED (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS f, unnest(embedding)::DOUBLE AS x FROM embeddings),
draws AS (SELECT CAST(t AS INTEGER) AS tree, vec_id, {_sql_fraction(str(SEED), "t", "vec_id")} AS draw FROM embeddings, range({TREES}) r(t)),
m0 AS MATERIALIZED (SELECT tree, vec_id, 0 AS node FROM (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY draw, CAST(vec_id AS VARCHAR)) AS r FROM draws), size WHERE r <= s),
{", ".join(_sql_level(k) for k in range(LEVELS + 1))},
nodes AS MATERIALIZED (SELECT *, CASE WHEN NOT is_leaf THEN 0 ELSE depth + CASE WHEN c <= 1 THEN 0 WHEN c = 2 THEN 1
    ELSE 2 * (ln(c - 1) + {op.EULER!r}::DOUBLE) - 2 * (c - 1) / c::DOUBLE END END AS path_len
  FROM ({" UNION ALL ".join(f"SELECT * FROM n{k}" for k in range(LEVELS + 1))}))"""
SQL_WALK = ", ".join(f"""
w{k + 1} AS (SELECT vec_id, tree, CASE WHEN is_leaf THEN node WHEN e.embedding[f + 1] <= split THEN 2 * node + 1 ELSE 2 * node + 2 END AS node
  FROM w{k} JOIN nodes USING (tree, node) JOIN embeddings e USING (vec_id))""" for k in range(LEVELS))
SQL_FITTED = f"""{SQL_FIT}, w0 AS (SELECT vec_id, tree, 0 AS node FROM embeddings, (SELECT DISTINCT tree FROM nodes)), {SQL_WALK},
fitted_raw AS MATERIALIZED (SELECT vec_id, -pow(2.0::DOUBLE, -avg(path_len) / (SELECT 2 * (ln(s - 1) + {op.EULER!r}::DOUBLE) - 2 * (s - 1) / s::DOUBLE FROM size)) AS raw
  FROM w{LEVELS} JOIN nodes USING (tree, node) GROUP BY vec_id),
fitted AS (SELECT vec_id, raw - (SELECT quantile_cont(raw, 0.1) FROM fitted_raw) AS score FROM fitted_raw)"""


def _fitted(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    return op.IsolationForestModel.fit(rows, n_estimators=TREES, seed=SEED, key=["vec_id"]), rows


@query(f"""
WITH {SQL_FIT} SELECT tree AS tree_id, CAST(node AS INTEGER) AS node_id, is_leaf, CAST(f AS INTEGER) AS feature, round(split::DOUBLE, 9) AS split,
  CAST(depth AS INTEGER) AS depth, c AS n_samples, round(path_len::DOUBLE, 9) AS path_len FROM nodes""")
def forest_fit_nodes(spark, folder):
    """A forest fitted on the embeddings, node by node."""
    nodes = _fitted(spark, folder)[0].nodes
    return nodes.select("tree_id", "node_id", "is_leaf", "feature", F.round("split", 9).alias("split"), "depth", "n_samples", F.round("path_len", 9).alias("path_len"))


@query(f"""
WITH {SQL_FITTED} SELECT vec_id, round(score, 9) AS anomaly_score, score >= 0 AS is_anomalous_by_contamination,
  score > (SELECT quantile_cont(score, 0.9) FROM fitted) AS for_review FROM fitted""")
def forest_fit_predict(spark, folder):
    """Fit, score and flag the embeddings."""
    model, rows = _fitted(spark, folder)
    scored_rows = model.flags(model.score(rows)).drop("features")
    return scored_rows.withColumn("anomaly_score", F.round("anomaly_score", 9))


@query(f"WITH {SCORED} SELECT round(quantile_cont(anomaly_score, 0.1), 9) AS score_offset, count(*) AS n FROM scored")
def contamination_offset(spark, folder):
    rows = checkpoint(scored(spark, folder, heavy=True).select("anomaly_score"))
    at = percentile(rows, "anomaly_score", 0.1)
    return rows.agg(F.round(F.lit(at), 9).alias("score_offset"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORED} SELECT round(quantile_cont(anomaly_score, 0.9), 9) AS threshold, count(*) AS n FROM scored")
def score_threshold(spark, folder):
    """The narrowing path of the percentile, forced by a small bound."""
    rows = checkpoint(scored(spark, folder, heavy=True).select("anomaly_score"))
    at = percentile(rows, "anomaly_score", 0.9, small=50)
    return rows.agg(F.round(F.lit(at), 9).alias("threshold"), F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {SCORED}, t AS (SELECT quantile_cont(anomaly_score, 0.9) AS t FROM scored)
SELECT piid, line_no, supp_no, part_no, anomaly_score >= 0 AS is_anomalous_by_contamination, anomaly_score > t AS for_review,
  CASE WHEN anomaly_score >= 0 THEN 1 ELSE -1 END AS label_by_contamination, CASE WHEN anomaly_score > t THEN -1 ELSE 1 END AS label_by_threshold
FROM scored, t""")
def review_flags(spark, folder):
    rows = scored(spark, folder).select("piid", "line_no", "supp_no", "part_no", "anomaly_score")
    limit = percentile(checkpoint(rows.select("anomaly_score")), "anomaly_score", 0.9)
    flagged = rows.withColumns({**op.flag_columns(F.col("anomaly_score"), limit), **op.label_columns(F.col("anomaly_score"), limit)})
    return flagged.drop("anomaly_score")


# Labeled lines: returned at a high discount. All other orders are scored.
def award_model(spark, folder, **settings) -> AwardModel:
    labeled = awards(spark, folder, heavy=True).where("return_flag = 'R' and discount >= 0.09")
    return AwardModel.fit(labeled, **settings)


@query()
def forest_fit_score(spark, folder):
    """Fit on the labeled order lines, score every line of the other orders."""
    model = award_model(spark, folder)
    columns = ["piid", "line_no", "supp_no", "part_no", "anomaly_score", "is_anomalous_by_contamination", "for_review"]
    return model.score(awards(spark, folder, heavy=True)).select(*columns)


@query()
def forest_fit_predict_documents(spark, folder):
    """Fit on the labeled documents, score the others, best first."""
    model = AwardModel.fit(labeled_docs(spark, folder))
    scored_docs = model.predict(docs(spark, folder))
    return scored_docs.select("piid", "agency", "vendor", "anomaly_score", "is_anomalous_by_contamination", "for_review")


def _explained(spark, folder):
    labeled = labeled_docs(spark, folder)
    model = AwardModel.fit(labeled)
    rows = model.features(prepare_labeled(labeled).drop("description"), wrap=False)
    return model, rows.select("doc_id", "features")


@query()
def shap_values(spark, folder):
    model, rows = _explained(spark, folder)
    return explain(model.forest, rows, model.feature_names(spark), "doc_id")


@query()
def shap_importance(spark, folder):
    model, rows = _explained(spark, folder)
    return importance(model.forest, rows, model.feature_names(spark))


@query()
def shap_summary(spark, folder):
    model, rows = _explained(spark, folder)
    return summary(checkpoint(explain(model.forest, rows, model.feature_names(spark), "doc_id")))


@query()
def projected_scores(spark, folder):
    """First two principal components of the labeled documents' fused features, with their score."""
    labeled = labeled_docs(spark, folder)
    model = AwardModel.fit(labeled)
    rows = checkpoint(model.features(prepare_labeled(labeled).drop("description")).select("doc_id", "features"))
    return analysis.pca_2d(model.forest.score(rows)).select("doc_id", "pc1", "pc2", "anomaly_score")


@query()
def fitted_threshold_sweep(spark, folder):
    """Sweep over the scores of a fitted model; the scores are stored, since two passes read them."""
    model = award_model(spark, folder)
    return agg.sweep(checkpoint(model.score(awards(spark, folder, heavy=True)).select("anomaly_score")))
