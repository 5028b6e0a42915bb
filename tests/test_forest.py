"""Properties of the forest, its scores and its Shapley values."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from awardsift.operators import explain, forest
from awardsift.plans.prepare import prepare_labeled, prepare_unlabeled
from awardsift.plans.similarity import AwardModel, load_model, save_model
from awardsift.streaming import score_stream


def table(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(x.tolist())], ["id", "features"])


@pytest.fixture(scope="module")
def x():
    random = np.random.default_rng(0)
    return np.vstack([random.normal(size=(290, 6)), random.normal(size=(10, 6)) * 0.1 + 9])


@pytest.fixture(scope="module")
def model(spark, x):
    return forest.IsolationForestModel.fit(table(spark, x), n_estimators=40, seed=7)


def walk(nodes, tree, row):
    node = nodes[(tree, 0)]
    while not node["is_leaf"]:
        node = nodes[(tree, node["left"] if row[node["feature"]] <= node["split"] else node["right"])]
    return node["path_len"]


def test_average_path():
    assert [forest.average_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    harmonic = sum(1 / i for i in range(1, 256))
    assert forest.average_path(256) == pytest.approx(2 * harmonic - 2 * 255 / 256, abs=1e-2)


def test_draws_are_exact_even_among_copies(spark):
    rows = spark.range(5000).select(F.monotonically_increasing_id().alias("row_id")).crossJoin(
        spark.createDataFrame([(Vectors.dense([1.0]),)], ["features"])).cache()
    draws = forest.tree_draws(rows, 5000, 20, 256, 1).groupBy("tree_id").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("d")).collect()
    assert len(draws) == 20 and all(r["n"] == r["d"] == 256 for r in draws)


def test_tree_shape(model):
    nodes = model.nodes.toPandas()
    assert nodes["tree_id"].nunique() == 40 and model.samples == 256
    assert nodes["depth"].max() <= math.ceil(math.log2(256))
    for _, tree in nodes.groupby("tree_id"):
        by_id = tree.set_index("node_id")
        assert by_id.loc[0, "n_samples"] == 256
        inner = tree[~tree["is_leaf"]]
        children = inner[["left", "right"]].map(lambda n: by_id.loc[n, "n_samples"]).sum(axis=1)
        assert (children.to_numpy() == inner["n_samples"].to_numpy()).all()
        leaves = tree[tree["is_leaf"]]
        expected = [d + forest.average_path(n) for d, n in zip(leaves["depth"], leaves["n_samples"])]
        assert leaves["path_len"].to_numpy() == pytest.approx(expected)


def test_scores_match_a_walk_in_python(spark, model, x):
    nodes = {(r["tree_id"], r["node_id"]): r for r in model.nodes.collect()}
    got = [r["anomaly_score"] for r in model.score(table(spark, x)).orderBy("id").collect()]
    for i in range(0, 300, 23):
        path = np.mean([walk(nodes, t, x[i]) for t in range(40)])
        assert got[i] == pytest.approx(-(2 ** (-path / forest.average_path(256))) - model.offset, abs=1e-12)


def test_offset_threshold_and_flagged_shares(spark, model, x):
    scored = model.labels(model.flags(model.score(table(spark, x)))).orderBy("id").toPandas()
    scores = scored["anomaly_score"].to_numpy()
    assert np.percentile(scores, 10) == pytest.approx(0.0, abs=1e-12)
    assert np.percentile(scores, 90) == pytest.approx(model.threshold, abs=1e-12)
    assert set(scored["label_by_contamination"]) | set(scored["label_by_threshold"]) == {-1, 1}
    assert abs((scored["label_by_contamination"] == -1).mean() - 0.1) < 0.05
    assert abs(scored["for_review"].mean() - 0.1) < 0.05
    assert ((scores >= 0) == scored["is_anomalous_by_contamination"]).all()
    assert ((scores > model.threshold) == (scored["label_by_threshold"] == -1)).all()
    # Rows unlike the rest score lowest.
    assert set(np.argsort(scores)[:10]) == set(range(290, 300))


def test_same_seed_same_forest(spark, model, x):
    again = forest.IsolationForestModel.fit(table(spark, x), n_estimators=40, seed=7)
    other = forest.IsolationForestModel.fit(table(spark, x), n_estimators=40, seed=8)
    assert (again.offset, again.threshold) == (model.offset, model.threshold)
    assert other.offset != model.offset


def test_threshold_override(spark, model, x):
    flagged = model.flags(model.score(table(spark, x)), threshold=-9.0)
    assert flagged.where("for_review").count() == 300


def test_sparse_and_dense_vectors_score_alike(spark, model, x):
    sparse = spark.createDataFrame([(i, Vectors.sparse(6, [(j, v) for j, v in enumerate(row) if v])) for i, row in enumerate(x.tolist())], ["id", "features"])
    mixed = sparse.where("id % 2 = 0").union(table(spark, x).where("id % 2 = 1")).coalesce(1)
    a = [r["anomaly_score"] for r in model.score(table(spark, x)).orderBy("id").collect()]
    b = [r["anomaly_score"] for r in model.score(mixed).orderBy("id").collect()]
    assert a == pytest.approx(b, abs=1e-12)


def test_constant_features_and_single_rows(spark):
    constant = forest.IsolationForestModel.fit(table(spark, np.ones((20, 3))), n_estimators=5)
    assert constant.nodes.count() == 5
    assert len({r["anomaly_score"] for r in constant.score(table(spark, np.ones((4, 3)))).collect()}) == 1
    single = forest.IsolationForestModel.fit(table(spark, np.ones((1, 3))), n_estimators=5)
    assert single.score(table(spark, np.ones((1, 3)))).count() == 1
    with pytest.raises(ValueError):
        forest.IsolationForestModel.fit(table(spark, np.ones((1, 3))).limit(0))


# --- Shapley values --------------------------------------------------------------------------

def exact_shapley(nodes, trees, row, features):
    """By definition: average over subsets, unknown features followed in both directions by cover."""
    def value(tree, node, known):
        n = nodes[(tree, node)]
        if n["is_leaf"]:
            return n["path_len"]
        if n["feature"] in known:
            return value(tree, n["left"] if row[n["feature"]] <= n["split"] else n["right"], known)
        left, right = nodes[(tree, n["left"])], nodes[(tree, n["right"])]
        return (left["n_samples"] * value(tree, n["left"], known) + right["n_samples"] * value(tree, n["right"], known)) / n["n_samples"]

    def mean(known):
        return np.mean([value(t, 0, known) for t in range(trees)])

    m = len(features)
    phi = {}
    for f in features:
        rest = [g for g in features if g != f]
        phi[f] = sum(
            math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) * (mean({*s, f}) - mean(set(s)))
            for k in range(m) for s in combinations(rest, k))
    return phi, mean(set())


@pytest.mark.parametrize("table_width", [9, 0])
def test_shapley_values_by_definition(spark, x, monkeypatch, table_width):
    monkeypatch.setattr(explain, "TABLE_WIDTH", table_width)
    small = forest.IsolationForestModel.fit(table(spark, x), n_estimators=4, max_samples=32, seed=3)
    nodes = {(r["tree_id"], r["node_id"]): r for r in small.nodes.collect()}
    phi = np.zeros((5, 6))
    for tree in range(4):
        block = np.zeros((5, len(small.arrays.columns)))
        explain.TreePaths(small.arrays, tree).add(x[:5][:, small.arrays.columns], block)
        phi[:, small.arrays.columns] += block / 4
    for i in range(5):
        expected, base = exact_shapley(nodes, 4, x[i], list(range(6)))
        assert phi[i] == pytest.approx([expected[f] for f in range(6)], abs=1e-9)
    assert explain.base_value(small) == pytest.approx(base)


def test_shapley_values_add_up(spark, model, x):
    rows = table(spark, x).limit(50)
    names = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "feature int, name string")
    values = explain.shap_values(model, rows, names, "id").cache()
    path = forest.mean_path_length(spark, model.arrays, F.col("features"))
    total = values.groupBy("id").agg(F.sum("phi").alias("phi")).join(rows.select("id", path.alias("path")), "id").collect()
    base = explain.base_value(model)
    assert len(total) == 50
    for r in total:
        assert r["phi"] + base == pytest.approx(r["path"], abs=1e-9)
    top = explain.shap_importance(values, 3).collect()
    assert len(top) == 3 and top[0]["mean_abs_phi"] >= top[1]["mean_abs_phi"] and top[0]["name"].startswith("f")
    summary = explain.shap_summary(values, 2)
    assert summary.count() == 100 and {"phi", "x", "mean_abs_phi"} <= set(summary.columns)


def test_tables_of_trees_are_bounded(model, x, monkeypatch):
    """Trees beyond the bound have no table in the worker, and the same values."""
    used = model.arrays.columns
    values = []
    for limit in (1 << 26, 0):
        monkeypatch.setattr(explain, "TABLE_BYTES", limit)
        arrays = forest.ForestArrays(**{k: v for k, v in vars(model.arrays).items() if not k.startswith("_")})
        out = np.zeros((20, len(used)))
        for tree in explain.tree_paths(arrays):
            tree.add(x[:20][:, used], out)
        values.append(out)
    assert all("table" not in vars(tree) for tree in explain.tree_paths(arrays))
    assert values[0] == pytest.approx(values[1], abs=1e-9)


# --- fit, score, save, load, stream ----------------------------------------------------------

AWARD = "piid string, description string, value string, vendor string, agency string, end_date string"


@pytest.fixture(scope="module")
def awards(spark):
    words = ["support", "training", "software", "road", "bridge", "audit", "travel", "paper", "staff", "lease"]
    random = np.random.default_rng(6)
    rows = [(f"p{i}", " ".join(random.choice(words, 5)), f"${random.integers(1, 10**6):,}", f"Vendor {i % 7} LLC", f"Dept {i % 3}", "2030-01-01")
            for i in range(120)]
    return spark.createDataFrame(rows, AWARD)


@pytest.fixture(scope="module")
def award_model(awards):
    return AwardModel.fit(awards.where("cast(substr(piid, 2) as int) < 80"), text_size=32, n_estimators=20)


def test_predict_contract(spark, awards, award_model):
    got = award_model.predict(awards).toPandas()
    assert len(got) == 40  # labeled ids are left out
    assert got["anomaly_score"].is_monotonic_decreasing
    for name, kind in {"anomaly_score": "float64", "is_anomalous_by_contamination": "bool", "for_review": "bool"}.items():
        assert got[name].dtype == kind
    assert {"piid", "clean_description", "normalized_value", "value_per_word", "description", "end_date"} <= set(got.columns)
    assert ((got["anomaly_score"] > award_model.forest.threshold) == got["for_review"]).all()


def test_save_and_load(spark, awards, award_model, tmp_path):
    save_model(award_model, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    a, b = (m.predict(awards).select("piid", "anomaly_score", "for_review").toPandas() for m in (award_model, loaded))
    pd.testing.assert_frame_equal(a.sort_values("piid", ignore_index=True), b.sort_values("piid", ignore_index=True))
    names = [[r["name"] for r in m.feature_names(spark).orderBy("feature").collect()] for m in (award_model, loaded)]
    assert names[0] == names[1] and len(names[0]) == award_model.fusion.size(32)
    with pytest.raises(Exception):
        load_model(spark, str(tmp_path / "nothing"))


def test_empty_input_gives_an_empty_table(spark, awards, award_model):
    assert award_model.predict(awards.limit(0)).count() == 0
    assert award_model.predict(awards.where("piid = 'p1'")).count() == 0
    with pytest.raises(ValueError):
        AwardModel.fit(awards.limit(0), text_size=8)


def test_missing_columns(spark, award_model):
    got = award_model.score(spark.createDataFrame([("n1", "road audit")], "piid string, description string")).first()
    assert got["normalized_value"] is None and got["agency"] is None and isinstance(got["anomaly_score"], float)


def test_prepared_goldens(spark):
    rows = spark.createDataFrame([("1", "CPN Safety, DB support #70", "$132,288", None, None), ("2", None, "x", "v", "a")],
                                 "piid string, description string, value string, vendor string, agency string")
    got = [r.asDict() for r in prepare_labeled(rows).orderBy("piid").collect()]
    assert got[0]["clean_description"] == "cpn safety db support 70" and got[0]["value_per_word"] == 132288 / 5
    assert got[0]["vendor"] == got[0]["agency"] == "Unknown" and got[0]["is_canceled"] is True
    assert got[1]["clean_description"] == "" and got[1]["normalized_value"] == got[1]["value_per_word"] == 0.0
    ids = spark.createDataFrame([("1",)], "piid string")
    assert [r["piid"] for r in prepare_unlabeled(rows, ids).collect()] == ["2"]


def test_stream_scores_like_a_batch(spark, awards, award_model, tmp_path):
    awards.where("piid like '%9'").write.parquet(str(tmp_path / "in"))
    awards.where("piid not like '%9'").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(AWARD).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    started = score_stream(award_model, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    started.awaitTermination(120)
    assert started.exception() is None
    got = spark.read.parquet(str(tmp_path / "out" / "scored")).select("piid", "anomaly_score").toPandas()
    expected = award_model.score(awards).select("piid", "anomaly_score").toPandas()
    pd.testing.assert_frame_equal(got.sort_values("piid", ignore_index=True), expected.sort_values("piid", ignore_index=True))
    review = spark.read.parquet(str(tmp_path / "out" / "review"))
    assert review.count() == award_model.score(awards).where("for_review").count()


# --- results that depend on the data alone ----------------------------------------------------

def test_forest_does_not_depend_on_partitioning(spark, x):
    """Copies of rows included: however the rows are dealt and ordered, the trees are the same."""
    copies = np.vstack([x[:60], x[:60], x[:30]])
    rows = table(spark, copies).select("features")
    fits = [forest.IsolationForestModel.fit(df, n_estimators=10, max_samples=32) for df in (
        rows.coalesce(1), rows.repartition(7), rows.orderBy(F.rand(1)), rows.repartition(3).orderBy(F.rand(2)))]
    nodes = [sorted(map(tuple, fit.nodes.collect())) for fit in fits]
    assert nodes[0] == nodes[1] == nodes[2] == nodes[3]
    assert len({(fit.offset, fit.threshold) for fit in fits}) == 1


def test_award_model_does_not_depend_on_partitioning(spark, awards, award_model):
    labeled = awards.where("cast(substr(piid, 2) as int) < 80")
    again = AwardModel.fit(labeled.repartition(5), text_size=32, n_estimators=20)
    assert (again.forest.offset, again.forest.threshold) == (award_model.forest.offset, award_model.forest.threshold)


def test_importance_is_that_of_the_long_table(spark, model, x, monkeypatch):
    monkeypatch.setattr(explain, "CELLS", 64)  # a few rows at a time
    rows = table(spark, x).limit(80)
    names = spark.createDataFrame([(i, f"f{i}") for i in range(6)], "feature int, name string")
    long = explain.shap_importance(explain.shap_values(model, rows, names, "id"), 4).collect()
    short = explain.importance(model, rows, names, 4).collect()
    assert [(r["feature"], r["name"]) for r in long] == [(r["feature"], r["name"]) for r in short]
    assert [r["mean_abs_phi"] for r in long] == pytest.approx([r["mean_abs_phi"] for r in short])


def test_columns_walk_like_the_workers(spark):
    """Sparse and dense vectors through a fitted forest, in Python workers and in the JVM."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 12)) * (rng.random((90, 12)) < 0.5)
    rows = [(i, Vectors.dense(v) if i % 2 else Vectors.sparse(12, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, ["id", "features"])
    model = forest.IsolationForestModel.fit(df, n_estimators=8, max_samples=32)
    columns = model.score(df, python=False)
    plan = columns._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
    ours = {r.id: r.anomaly_score for r in columns.collect()}
    assert all(abs(ours[r.id] - r.anomaly_score) < 1e-9 for r in model.score(df).collect()) and len(ours) == 90
    one = forest.IsolationForestModel.fit(df.limit(1), n_estimators=2)  # trees of a single leaf
    assert {r.anomaly_score for r in one.score(df, python=False).collect()} == {r.anomaly_score for r in one.score(df).collect()}
