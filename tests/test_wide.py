"""Components and correlated pairs of wide vectors against NumPy, on every path."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from awardsift.operators import analysis, wide


def _frame(spark, x, sparse=True):
    rows = [(i, Vectors.sparse(x.shape[1], {int(j): float(r[j]) for j in np.flatnonzero(r)}) if sparse else Vectors.dense(r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, ["id", "features"]).repartition(4)


def _table(seed=3, n=120, width=300):
    """Sparse counts with a few strong directions, copies of columns, columns of one row, full and constant ones."""
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.05, (n, width)).astype(float)
    x[:, :20] += np.outer(rng.poisson(2.0, n), rng.integers(0, 3, 20))
    x[:, 20:30] += np.outer(rng.poisson(1.0, n), rng.integers(0, 4, 10))
    x[:, 30] = 2 * x[:, 60]
    x[:, 31] = x[:, 61] + (rng.random(n) < 0.01)
    x[:, 32], x[:, 33] = (on := rng.random(n) < 0.5), ~on
    x[:, 34] = 5.0
    x[:, 35] = rng.normal(size=n)
    x[:, 36], x[:, 37] = -x[:, 35] + 0.01, x[:, 35] * 3 + 100
    x[:, 38] = 0
    x[0] = 0
    return x


def _pairs(x, limit):
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.corrcoef(x.T)
    return {(i, j): r[i, j] for i in range(len(r)) for j in range(i) if abs(r[i, j]) > limit}


@pytest.mark.parametrize("limit", [wide.BLOCK_BYTES, 1])
def test_components_against_numpy(spark, limit):
    x = _table()
    centred = x - x.mean(0)
    _, s, axes = np.linalg.svd(centred, full_matrices=False)
    share = s**2 / (s**2).sum()
    found = wide.variance(_frame(spark, x), k=4, limit=limit).orderBy("component").collect()
    assert np.allclose([r.variance_ratio for r in found], share[:4], atol=1e-8)
    assert np.allclose([r.cumulative_ratio for r in found], np.cumsum(share[:4]), atol=1e-8)
    assert all(r.error_bound < 1e-4 and abs(r.variance_ratio - t) <= r.error_bound + 1e-12 for r, t in zip(found, share))
    placed = wide.project(_frame(spark, x), k=2, limit=limit).orderBy("id").collect()
    got = np.array([[r.pc1, r.pc2] for r in placed])
    assert np.allclose(np.abs(got), np.abs(centred @ axes[:2].T), atol=1e-3)


@pytest.mark.parametrize(("limit", "block"), [(0.5, wide.BLOCK_BYTES), (0.9, wide.BLOCK_BYTES), (0.9, 1)])
def test_pairs_against_numpy(spark, limit, block):
    x = _table()
    if block == 1:  # joins instead of a block that is sent
        x = x[:, 20:90]
    expected = _pairs(x, limit)
    rows = wide.correlated(_frame(spark, x, sparse=block != 1), limit=limit, block_bytes=block).collect()
    got = {(r.i, r.j): r.r for r in rows}
    assert len(got) == len(rows) and set(got) == set(expected) and len(got) >= 3
    assert all(abs(got[p] - expected[p]) < 1e-9 for p in got)


def test_pairs_of_sparse_columns(spark):
    """Many columns of few cells, some of them near copies, in rows of very different lengths."""
    rng = np.random.default_rng(5)
    x = np.zeros((400, 250))
    for c in range(0, 250, 2):
        at = rng.choice(400, rng.integers(1, 40), replace=False)
        x[at, c] = rng.integers(1, 5, len(at))
        x[:, c + 1] = x[:, c] * (rng.random(400) < 0.97)
    x[7] = rng.integers(0, 2, 250)
    expected = _pairs(x, 0.9)
    got = {(r.i, r.j): r.r for r in wide.correlated(_frame(spark, x), limit=0.9).collect()}
    assert set(got) == set(expected) and len(got) > 50


def test_products_in_slices(spark, monkeypatch):
    """The covariance times a block, with slices shorter than a row, rows without cells and columns of no row."""
    monkeypatch.setattr(wide, "SLICE", 5, raising=False)
    x = _table(n=60, width=80)
    x[[0, 20, 59]] = 0
    q = np.random.default_rng(1).normal(size=(80, 3))
    data = wide.Wide.of(_frame(spark, x))
    rows, counts = data.rows.select("at", "x").coalesce(1).toArrow().combine_chunks().to_batches()[0], []
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda v, *a, **k: counts.append(len(v)) or bincount(v, *a, **k))
    (got,) = wide._products(type("Sent", (), {"value": (q, x.mean(0) @ q)}), 80)(iter([rows]))
    z = np.zeros_like(q)
    z[got["col"].to_numpy()] = np.column_stack([got[f"z{k}"].to_numpy() for k in range(3)])
    assert np.allclose(z, x.T @ ((x - x.mean(0)) @ q))
    assert max(counts) <= max(5, (x != 0).sum(axis=1).max())


@pytest.mark.parametrize("block", [wide.BLOCK_BYTES, 1])
def test_columns_that_only_meet_are_not_joined(spark, monkeypatch, block):
    """Columns that share rows but go apart are dropped by the products of their heads; few pairs are left to be joined with all cells."""
    rng = np.random.default_rng(11)
    x = (rng.random((300, 200)) < 0.05).astype(float) * rng.integers(1, 4, (300, 200))
    x[:, 7], x[:, 90] = x[:, 120], x[:, 121] * 2
    expected, joined, store = _pairs(x, 0.9), [], wide.store

    def watched(df):
        out = store(df)
        if set(out.columns) == {"col", "col2"}:
            joined.append(out.count())
        return out

    monkeypatch.setattr(wide, "store", watched)
    monkeypatch.setattr(wide, "TILE", 64, raising=False)
    monkeypatch.setattr(wide, "CHUNK", 500, raising=False)
    got = {(r.i, r.j): r.r for r in wide.correlated(_frame(spark, x), limit=0.9, block_bytes=block).collect()}
    assert set(got) == set(expected) and {(120, 7), (121, 90)} <= set(got)
    assert len(joined) == 1 and joined[0] < 200  # of some 15,000 pairs that share a row


def test_word_counts_of_repeated_documents(spark, tmp_path):
    """One row a doc_id, null included, with the words of all its texts; a document without words has no cells."""
    from awardsift.catalog.features import WORD_COLUMNS, _word_counts

    texts = [(1, "One two, ONE"), (2, None), (1, "two2three"), (None, "a"), (None, "b a"), (3, " 12 ")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.features for r in _word_counts(spark, str(tmp_path)).collect()}

    def of(*words):
        counts = Counter(int(hashlib.md5(w.encode()).hexdigest()[:4], 16) for w in words)
        return sorted(counts), [float(counts[c]) for c in sorted(counts)]

    wanted = {1: of("one", "two", "one", "two", "three"), 2: of(), 3: of(), None: of("a", "b", "a")}
    assert {doc: (f.indices, f["values"]) for doc, f in got.items()} == wanted
    assert {f.size for f in got.values()} == {WORD_COLUMNS} and len(got) == 4


def test_very_wide(spark):
    """100,000 columns: the dense matrix would take 80 GB."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(60):
        cells = {int(c): 1.0 for c in rng.choice(99_000, 30, replace=False)} | {99_500 + k: float(i % 5 * (k + 1)) for k in range(3) if i % 5}
        rows.append((i, Vectors.sparse(100_000, cells)))
    df = spark.createDataFrame(rows, ["id", "features"])
    x = np.zeros((60, 100_000))
    for i, v in rows:
        x[i, v.indices] = v.values
    gram = (x - x.mean(0)) @ (x - x.mean(0)).T
    share = np.linalg.eigvalsh(gram)[::-1] / np.trace(gram)
    first = analysis.pca_variance(df).orderBy("component").first()
    assert abs(first.variance_ratio - share[0]) < 1e-6
    pairs = {(r.i, r.j) for r in analysis.correlation_pairs(df).collect()}
    assert {(99_501, 99_500), (99_502, 99_501), (99_502, 99_500)} <= pairs
    assert analysis.pca_2d(df).count() == 60
    with pytest.raises(ValueError, match="use correlation_pairs"):
        analysis.correlations(df)


def test_few_rows(spark):
    one = _frame(spark, np.ones((1, 5)))
    flat = _frame(spark, np.ones((4, 5)))
    for df in (one, flat, one.limit(0)):
        assert wide.variance(df).count() == wide.project(df).count() == wide.correlated(df).count() == 0
    two = _frame(spark, np.array([[1.0, 0, 2], [0, 1, 4]]))
    assert wide.variance(two).count() == 1 and [r.pc2 for r in wide.project(two).collect()] == [None, None]
