"""Operators against plain Python and NumPy on small tables, including the paths for large inputs."""

import datetime
import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from awardsift.operators import aggregates, analysis, encoding, filters, joins, ranks, schema_ops
from awardsift.operators.embed import hashing_embedding, model_embedding, precomputed_embedding
from awardsift.operators.fusion import FusionModel


def test_percentile_narrows_to_the_exact_value(spark):
    random = np.random.default_rng(1)
    skewed = np.concatenate([random.normal(size=3000), np.full(2000, 0.25), random.exponential(size=999)])
    rows = spark.createDataFrame(pd.DataFrame({"x": skewed})).persist()
    for share in (0.0, 0.1, 0.5, 0.613, 0.9, 1.0):
        for small in (20, 500, 100_000):
            assert ranks.percentile(rows, "x", share, small=small) == pytest.approx(np.percentile(skewed, 100 * share), rel=1e-12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.floats(0, 1))
def test_percentile_of_any_list(spark, numbers, share):
    rows = spark.createDataFrame([(x,) for x in numbers], "x double")
    assert ranks.percentile(rows, "x", share, small=5) == pytest.approx(np.percentile(numbers, 100 * share), rel=1e-9, abs=1e-9)


def test_first_n_and_positions_above_the_bound(spark):
    numbers = list(np.random.default_rng(2).permutation(1000))
    rows = spark.createDataFrame([(int(x), int(x) % 3) for x in numbers], "x int, g int").repartition(7)
    for n in (1, 499, 1000, 2000):
        got = [r["x"] for r in ranks.first_n(rows, n, F.col("x"), small=10).collect()]
        assert sorted(got) == list(range(min(n, 1000)))
    placed = ranks.positions(rows, "at", F.desc("g"), F.col("x"), small=10).collect()
    order = sorted(range(1000), key=lambda x: (-(x % 3), x))
    assert sorted((r["at"], r["x"]) for r in placed) == list(enumerate(order))


def test_exact_sample(spark):
    rows = spark.range(2000).withColumnRenamed("id", "key")
    expected = sorted(range(2000), key=lambda k: (hashlib.md5(f"9|{k}".encode()).hexdigest(), k))
    for n in (5, 700, 1999, 5000):
        for small in (10, 100_000):
            got = sorted(r["key"] for r in ranks.exact_sample(rows, n, "key", seed=9, small=small).collect())
            assert got == sorted(expected[:n])


def test_stratified_split_with_one_large_stratum(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") < 2700, "big").when(F.col("id") < 2990, "mid").alias("s"))
    split = ranks.stratified_split(rows, "s", "key", 0.8).groupBy("s").agg(F.count("*").alias("n"), F.count_if("is_train").alias("t")).collect()
    assert {r["s"]: (r["n"], r["t"]) for r in split} == {"big": (2700, 2160), "mid": (290, 232), None: (10, 8)}


def test_rollup_skips_nulls_and_null_ids(spark):
    rows = spark.createDataFrame(
        [("a", None, 1.0, "2020-01-01", "v1", None, 1), ("a", "d2", 5.0, None, "v2", "g2", 2), ("a", "d3", None, "2021-01-01", None, "g3", 3),
         (None, "x", 9.0, None, "v", "g", 4)],
        "piid string, description string, value double, end_date string, vendor string, agency string, at int")
    got = aggregates.rollup_awards(rows, ["piid"], ["at"]).collect()
    assert [r.asDict() for r in got] == [
        {"piid": "a", "description": "d2", "value": 5.0, "end_date": "2021-01-01", "vendor": "v1", "agency": "g2"}]


def test_sweep_matches_direct_counts(spark):
    scores = np.concatenate([np.random.default_rng(3).normal(size=500), [0.1] * 200])
    got = {r["step"]: (r["threshold"], r["flagged"]) for r in aggregates.sweep(spark.createDataFrame(pd.DataFrame({"anomaly_score": scores}))).collect()}
    grid = np.linspace(scores.min(), scores.max(), 50)
    assert sorted(got) == list(range(50))
    for i, t in enumerate(grid):
        assert got[i] == (pytest.approx(t), int((scores > got[i][0]).sum()))
    flat = aggregates.sweep(spark.createDataFrame([(2.0,)] * 4, "anomaly_score double")).collect()
    assert len(flat) == 50 and all(r["threshold"] == 2.0 and r["flagged"] == 0 for r in flat)


def test_density_against_numpy(spark):
    # The outlier leaves most points out of reach of most rows.
    for x in (np.random.default_rng(8).normal(size=400), np.append(np.random.default_rng(9).normal(size=3000) * 1e-3, 50.0)):
        got = aggregates.density(spark.createDataFrame(pd.DataFrame({"x": x})), "x", 40).orderBy("i").collect()
        width = x.std(ddof=1) * len(x) ** -0.2
        grid = np.linspace(x.min(), x.max(), 40)
        expected = np.exp(-0.5 * ((grid[:, None] - x) / width) ** 2).sum(axis=1) / (len(x) * width * np.sqrt(2 * np.pi))
        assert [r["point"] for r in got] == pytest.approx(list(grid))
        assert [r["density"] for r in got] == pytest.approx(list(expected), rel=1e-9, abs=1e-15)


def test_histogram_and_grid_of_equal_values(spark):
    rows = spark.createDataFrame([(2.0, 0.0, True)] * 3, "anomaly_score double, normalized_value double, for_review boolean")
    assert [(r["bin"], r["n"]) for r in aggregates.histogram(rows, "anomaly_score", 3).orderBy("bin").collect()] == [(0, 3), (1, 0), (2, 0)]
    assert aggregates.value_score_grid(rows).first().asDict() == {
        "score_bin": 0, "value_bin": 0, "for_review": True, "log_scale": False, "n": 3}


def test_metrics_without_flagged_rows_are_zero(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 1, 0.2)], "y int, p int, s double")
    assert aggregates.evaluate(rows, "y", "p").first().asDict() == {"precision": 0.0, "recall": 0.0, "f1_score": 0.0}
    table = aggregates.threshold_metrics(rows, "s", "y", [0.1, 0.9]).collect()
    assert [(r["threshold"], r["precision"], r["recall"]) for r in sorted(table)] == [(0.1, 0.0, 0.0), (0.9, 0.0, 0.0)]


def test_date_ranges(spark):
    def ranges(start, end, months=3):
        return [(str(r[0]), str(r[1])) for r in joins.date_ranges(spark, start, end, months).collect()]

    assert ranges("2024-01-31", "2024-08-15") == [("2024-01-31", "2024-04-29"), ("2024-04-30", "2024-07-29"), ("2024-07-30", "2024-08-15")]
    assert ranges("2024-01-01", "2024-04-01") == [("2024-01-01", "2024-03-31")]
    assert ranges("2024-11-30", "2025-03-05") == [("2024-11-30", "2025-02-27"), ("2025-02-28", "2025-03-05")]
    assert ranges("2024-01-01", "2024-01-01") == []
    assert ranges("2023-12-15", "2024-02-20", 1) == [("2023-12-15", "2024-01-14"), ("2024-01-15", "2024-02-14"), ("2024-02-15", "2024-02-20")]


def test_assign_range(spark):
    rows = spark.createDataFrame([("2024-03-31",), ("2024-04-01",), ("2023-01-01",), (None,)], "d string")
    got = joins.assign_range(rows, "2024-01-01", "2024-12-31", "d").collect()
    assert [(r["d"], str(r["range_start"])) for r in got] == [("2024-03-31", "2024-01-01"), ("2024-04-01", "2024-04-01")]
    assert joins.assign_range(rows, "2024-01-01", "2024-01-01", "d").count() == 0


def test_active_is_strict_and_drops_bad_dates(spark):
    rows = spark.createDataFrame([("2024-01-01",), ("2024-01-02",), ("bad",), (None,), ("3/11/2025",)], "end_date string")
    assert [r["end_date"] for r in filters.active(rows, "2024-01-01").collect()] == ["2024-01-02", "3/11/2025"]


def test_anti_join_keeps_null_ids(spark):
    rows = spark.createDataFrame([("a",), (None,), ("b",)], "piid string")
    ids = joins.distinct_ids(spark.createDataFrame([("a",), (None,)], "piid string"))
    assert sorted(str(r["piid"]) for r in joins.exclude_labeled(rows, ids).collect()) == ["None", "b"]


def test_align_keeps_essential_columns(spark):
    a = spark.createDataFrame([("1", "d", 2)], "piid string, description string, savings int")
    b = spark.createDataFrame([("2", "x")], "piid string, end_date string")
    left, right = schema_ops.align(a, b)
    assert left.columns == right.columns == ["piid", "description"]
    assert right.first()["description"] is None


def test_categorical_features_without_columns(spark):
    got = schema_ops.categorical_features(spark.range(2), ["agency", "vendor"])
    assert got.columns == ["agency", "vendor"] and got.count() == 2


def test_observed_counts(spark):
    rows, before = filters.observed(spark.range(10), "in")
    kept, after = filters.observed(rows.where("id > 6"), "out")
    assert kept.count() == 3
    assert (before.get["rows"], after.get["rows"]) == (10, 3)


def test_page_cutoff(spark):
    pages = spark.createDataFrame([(1, 2, 9), (2, 2, 9), (3, 0, 9), (4, 2, 9)], "page int, n_items int, pages int")
    assert [r["page"] for r in aggregates.page_cutoff(pages, 10).orderBy("page").collect()] == [1, 2]
    assert [r["page"] for r in aggregates.page_cutoff(pages, 1).collect()] == [1]
    announced = spark.createDataFrame([(1, 2, 2), (2, 2, 2), (3, 2, 2)], "page int, n_items int, pages int")
    assert aggregates.page_cutoff(announced, 10).count() == 2


# --- features --------------------------------------------------------------------------------

def test_constant_column_is_only_centred(spark):
    train, test = encoding.scale_columns(spark.createDataFrame([(5.0,), (5.0,)], "x double"), spark.createDataFrame([(7.0,), (None,)], "x double"), ["x"])
    assert [r["x"] for r in train.collect()] == [0.0, 0.0]
    assert [r["x"] for r in test.collect()] == [2.0, -5.0]


def _fusion_rows(spark):
    names = ["Alpha Inc"] * 6 + ["Beta"] * 4 + ["Gamma"] * 3 + ["Unavailable"] * 5 + [None] * 2 + [f"V{i}" for i in range(8)]
    rows = [(f"p{i}", "Dept A" if i % 3 else "Dept B", v, float(i)) for i, v in enumerate(names)]
    return spark.createDataFrame(rows, "piid string, agency string, vendor string, normalized_value double")


def test_fusion_top_share_and_unknown(spark):
    model = FusionModel.fit(_fusion_rows(spark))
    agency, vendor = model.categories
    # 2 agencies -> 1 kept; 11 named vendors -> 2 kept; the rest is 'Unknown'. Slots are alphabetical.
    assert {r["category"]: r["slot"] for r in agency.table.collect()} == {"Unknown": 0, "dept a": 1}
    assert {r["category"]: r["slot"] for r in vendor.table.collect()} == {"Unknown": 0, "alpha": 1, "beta": 2}
    assert model.size(0) == 6
    fresh = spark.createDataFrame([("q", "DEPT A.", "alpha llc", 3.0), ("r", "Other", None, None)], "piid string, agency string, vendor string, normalized_value double")
    got = {r["piid"]: r["features"].toArray() for r in model.transform(fresh).collect()}
    _, mean, std = model.numeric[0]
    assert got["q"] == pytest.approx([(3.0 - mean) / std, 0, 1, 0, 1, 0])
    assert got["r"] == pytest.approx([-mean / std, 1, 0, 1, 0, 0])
    names = [r["name"] for r in model.feature_names(spark, 0).orderBy("feature").collect()]
    assert names == ["num_normalized_value", "agency_Unknown", "agency_dept a", "vendor_Unknown", "vendor_alpha", "vendor_beta"]


def test_fusion_shuffle_join_gives_the_same(spark, monkeypatch):
    rows = _fusion_rows(spark)
    model = FusionModel.fit(rows)
    expected = sorted((r["piid"], list(r["features"].toArray())) for r in model.transform(rows).collect())
    monkeypatch.setattr("awardsift.session.BROADCAST_ROWS", 0)
    monkeypatch.setattr("awardsift.operators.ranks.SMALL", 0)
    assert sorted((r["piid"], list(r["features"].toArray())) for r in model.transform(rows).collect()) == expected


def test_literal_unknown_competes(spark):
    rows = spark.createDataFrame([("unknown", "v")] * 5 + [("x", "v")] * 2, "agency string, vendor string")
    kept = [r["category"] for r in FusionModel.fit(rows, literal_unknown=True).categories[0].table.collect()]
    assert "unknown" in kept
    assert "unknown" not in [r["category"] for r in FusionModel.fit(rows).categories[0].table.collect()]


def test_unseen_categories_give_zeros(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "agency string")
    encoder = encoding.encoder_categories(train, ["agency", "vendor"])
    got = [list(r["agency_vector"].toArray()) for r in encoding.one_hot(spark.createDataFrame([("b",), ("zzz",)], "agency string"), encoder).collect()]
    assert sorted(got) == [[0, 0, 0], [0, 0, 1]]


def test_combine_and_fit_transform(spark):
    rows = spark.createDataFrame([(1.0, Vectors.dense([2.0, 3.0]))], ["x", "v"])
    assert list(encoding.combine(rows, ["v", "x"]).first()["features"].toArray()) == [2.0, 3.0, 1.0]
    model = FusionModel()
    assert model.fit_transform(_fusion_rows(spark)).count() == 28 and model.numeric


def test_transform_before_fit_raises(spark):
    with pytest.raises(ValueError):
        FusionModel().transform(spark.range(1))


def test_hashing_embedding_by_hand(spark):
    def bucket(word):
        return int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 32

    text = "red red blue"
    got = hashing_embedding(spark.createDataFrame([(text,), ("",), (None,)], "clean_description string"), size=32).collect()
    expected = np.zeros(32)
    for word in text.split():
        expected[bucket(word)] += 1
    assert got[0]["text_vector"].toArray() == pytest.approx(expected / np.linalg.norm(expected))
    assert got[1]["text_vector"].toArray().sum() == got[2]["text_vector"].toArray().sum() == 0


def test_model_embedding_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 2
            return np.array([[len(t), 1.0, 2.0] for t in texts])
        return encode

    rows = spark.createDataFrame([("abc",), (None,), ("de",)], "clean_description string").coalesce(1)
    got = [list(r["text_vector"].toArray()) for r in model_embedding(rows, make, batch_size=2).collect()]
    assert got == [[3, 1, 2], [0, 1, 2], [2, 1, 2]]


def test_precomputed_embedding(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "piid string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "piid string, embedding array<double>")
    assert [list(r["text_vector"].toArray()) for r in precomputed_embedding(rows, vectors, "piid").collect()] == [[1.0, 2.0]]


# --- analysis --------------------------------------------------------------------------------

def _matrix(spark, x):
    return spark.createDataFrame([(i, Vectors.dense(row)) for i, row in enumerate(x.tolist())], ["id", "features"])


def test_pca_against_numpy(spark):
    x = np.random.default_rng(4).normal(size=(60, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    got = analysis.pca_variance(_matrix(spark, x)).orderBy("component").collect()
    assert [r["variance_ratio"] for r in got] == pytest.approx(list(values / values.sum()))
    assert got[0]["components_for_95"] == int(np.argmax(np.cumsum(values / values.sum()) >= 0.95)) + 1
    centred = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    placed = analysis.pca_2d(_matrix(spark, x)).orderBy("id").collect()
    assert np.abs([[r["pc1"], r["pc2"]] for r in placed]) == pytest.approx(np.abs(centred @ axes[:2].T))


def test_correlations_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(50, 4))
    x[:, 2] = x[:, 0] * -2 + 0.01 * x[:, 1]
    x[:, 3] = 1.0
    got = {(r["i"], r["j"]): r["r"] for r in analysis.correlations(_matrix(spark, x)).collect()}
    assert set(got) == {(i, j) for j, i in combinations(range(4), 2)}
    assert got[(2, 0)] == pytest.approx(np.corrcoef(x[:, 2], x[:, 0])[0, 1])
    assert [(r["i"], r["j"]) for r in analysis.correlation_pairs(_matrix(spark, x)).collect()] == [(2, 0)]


def test_analysis_of_too_little_data_is_empty(spark):
    one = _matrix(spark, np.ones((1, 3)))
    assert analysis.pca_variance(one).count() == analysis.pca_2d(one).count() == analysis.correlation_pairs(one).count() == 0


def test_rows_removed_by_placeholder_filter(spark):
    rows = spark.createDataFrame([("Unavailable",), ("Charge Card Purchase",), ("unavailable",), (None,)], "piid string")
    assert filters.drop_placeholders(rows).count() == 2
    assert filters.drop_placeholders(spark.range(3)).count() == 3


def test_top_label(spark):
    rows = spark.createDataFrame([("a", 0.5, "t" * 60, 1234.4), ("b", 0.9, "short", 2.0)], "piid string, anomaly_score double, clean_description string, normalized_value double")
    got = aggregates.top_n(rows, 5).orderBy("rank").collect()
    assert [(r["rank"], r["piid"], r["label"]) for r in got] == [(1, "b", "$2: short"), (2, "a", "$1,234: " + "t" * 47 + "...")]


def test_dates_are_dates():
    assert joins._add_months(datetime.date(2024, 1, 31), 1) == datetime.date(2024, 2, 29)
    assert joins._add_months(datetime.date(2024, 10, 31), 3) == datetime.date(2025, 1, 31)


def test_percentile_is_the_same_whatever_the_bound(spark):
    """Bit for bit: a bound says how rows are gathered, never what comes out."""
    import random

    draw = random.Random(4)
    numbers = [round(draw.random() * 3 - 1, 8) for _ in range(900)] + [0.25] * 99
    rows = spark.createDataFrame([(v,) for v in numbers], "x double").repartition(5).cache()
    for share in (0.0, 0.1, 0.333, 0.5, 0.603, 0.9, 0.95, 1.0):
        assert ranks.percentile(rows, "x", share) == ranks.percentile(rows, "x", share, small=20)


def test_schema_does_not_grow_with_slots(spark):
    """One-hot and fused vectors describe no slots: 10 or 50,000 categories, the schema is the same."""
    from awardsift.operators import encoding

    sizes = []
    for n in (10, 50_000):
        rows = spark.range(n).select(F.concat(F.lit("v"), "id").alias("vendor"), F.col("id").cast("double").alias("x"))
        encoder = encoding.encoder_categories(rows, ["vendor"])
        made = encoding.combine(encoding.one_hot(rows.limit(5), encoder), ["x", "vendor_vector"])
        sizes.append(len(made.schema.json()))
        vector = made.first()["features"]
        assert vector.size == n + 1
    assert sizes[0] == sizes[1]


def test_joined_vectors(spark):
    """Dense, sparse and number parts, zeros left out; a slot beyond the end is empty."""
    from pyspark.ml.linalg import Vectors

    from awardsift.operators import encoding, vectors

    rows = spark.createDataFrame([(1, Vectors.dense([1.0, 0.0, 3.0]), Vectors.sparse(4, [2], [5.0]), 0.5), (2, Vectors.dense([0.0, 0.0, 0.0]), Vectors.sparse(4, [], []), 0.0)], ["id", "a", "b", "x"])
    got = {r["id"]: r["features"] for r in encoding.combine(rows, ["a", "x", "b"]).collect()}
    assert got[1] == Vectors.sparse(8, [0, 2, 3, 6], [1.0, 3.0, 0.5, 5.0]) and got[2] == Vectors.sparse(8, [], [])
    one = spark.createDataFrame([(0,), (2,), (3,), (None,)], "s int").select("s", vectors.as_vector(vectors.single(F.col("s"), 3)).alias("v"))
    assert {r["s"]: r["v"].toArray().tolist() for r in one.collect()} == {0: [1, 0, 0], 2: [0, 0, 1], 3: [0, 0, 0], None: [0, 0, 0]}


@pytest.mark.parametrize("draw", [lambda g: g.normal(size=5000), lambda g: g.standard_cauchy(2000), lambda g: np.r_[np.zeros(500), 1.0], lambda g: g.random(3)])
def test_density_against_all_kernels(spark, draw):
    """Far outliers, one value many times, and few rows: as the sum over all rows, to rounding."""
    x = draw(np.random.default_rng(2))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(3)
    found = aggregates.density(df, "x", 50).orderBy("i").collect()
    h = x.std(ddof=1) * len(x) ** -0.2
    points = np.linspace(x.min(), x.max(), 50)
    exact = np.exp(-0.5 * ((points[:, None] - x[None, :]) / h) ** 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.point for r in found], points) and np.allclose([r.density for r in found], exact, atol=1e-11 * exact.max(), rtol=1e-9)
