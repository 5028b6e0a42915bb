"""Shapley values of the forest, per row and feature.

Path-dependent tree explanations (Lundberg et al., 2018): a leaf adds its path length to a coalition
with weight "condition met" for features in the coalition and "share of the sample that met it" for
the others. The Shapley value of such a product is an integral over the multilinear extension (Owen,
1972) of a polynomial of the path's length, which a Gauss rule with half as many points gives exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .forest import ForestArrays, IsolationForestModel, _dense
from .vectors import parts

ROWS_AT_A_TIME = 512
CELLS = 1 << 20  # rows x used features made dense at a time
TABLE_WIDTH = 9  # longest path for which all patterns of met conditions are tabulated
TABLE_BYTES = 1 << 26  # of one worker's tables; further trees work out each row


class TreePaths:
    """The leaves of one tree: per leaf the distinct features on its path, the interval each must lie
    in and the share of the sample that passed. Short paths are padded with a feature that never matters."""

    def __init__(self, forest: ForestArrays, tree: int):
        leaves = []
        todo = [(0, {})]
        while todo:
            node, path = todo.pop()
            if forest.leaf[tree, node]:
                leaves.append((node, path))
                continue
            feature, split, cover = forest.feature[tree, node], forest.split[tree, node], forest.cover[tree, node]
            low, high, share = path.get(feature, (-np.inf, np.inf, 1.0))
            for child, bounds in ((forest.left[tree, node], (low, min(high, split))), (forest.right[tree, node], (max(low, split), high))):
                passed = share * forest.cover[tree, child] / cover
                todo.append((child, {**path, feature: (*bounds, passed)}))
        width = max((len(path) for _, path in leaves), default=0) or 1
        shape = (len(leaves), width)
        self.feature = np.zeros(shape, int)
        self.low, self.high, self.share = np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape)
        self.value = np.array([forest.path[tree, node] for node, _ in leaves])
        for i, (_, path) in enumerate(leaves):
            for j, (feature, (low, high, share)) in enumerate(path.items()):
                self.feature[i, j], self.low[i, j], self.high[i, j], self.share[i, j] = feature, low, high, share
        self.tabulated = width <= TABLE_WIDTH
        self.base = float((self.value * self.share.prod(axis=1)).sum())

    def contributions(self, met: np.ndarray) -> np.ndarray:
        """Shapley values of the path features for 0/1 arrays of met conditions: leaf x case x feature."""
        width = self.share.shape[1]
        points, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        points, weights = (points + 1) / 2, weights / 2
        share = self.share[:, None, :]
        factor = met[..., None] * points + share[..., None] * (1 - points)
        before, after = np.ones_like(factor), np.ones_like(factor)
        for j in range(1, width):
            before[:, :, j] = before[:, :, j - 1] * factor[:, :, j - 1]
            after[:, :, width - 1 - j] = after[:, :, width - j] * factor[:, :, width - j]
        return self.value[:, None, None] * (met - share) * ((before * after) @ weights)

    @cached_property
    def table(self) -> np.ndarray:
        """``contributions`` for all 2^width patterns of met conditions."""
        width = self.share.shape[1]
        patterns = (np.arange(2**width)[:, None] >> np.arange(width)) & 1
        return self.contributions(np.broadcast_to(patterns, (len(self.value), *patterns.shape)))

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        """Add this tree's contributions for the rows of ``x`` to ``out`` (rows x features)."""
        order = np.argsort(self.feature.ravel(), kind="stable")
        features, starts = np.unique(self.feature.ravel()[order], return_index=True)
        width = self.feature.shape[1]
        powers = 1 << np.arange(width)
        step = ROWS_AT_A_TIME if self.tabulated else max(1, ROWS_AT_A_TIME // 16)
        for at in range(0, len(x), step):
            seen = x[at:at + step][:, self.feature]
            met = (seen > self.low) & (seen <= self.high)
            if self.tabulated:
                parts = self.table[np.arange(len(self.value)), met @ powers]
            else:
                parts = self.contributions(met.transpose(1, 0, 2)).transpose(1, 0, 2)
            parts = parts.reshape(len(met), -1)
            out[at:at + step, features] += np.add.reduceat(parts[:, order], starts, axis=1)


def base_value(model: IsolationForestModel) -> float:
    """Mean path length when no feature is known; a row's Shapley values add up to its own minus this."""
    paths = tree_paths(model.arrays)
    return sum(tree.base for tree in paths) / len(paths)


def _blocks(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Pieces of batches (key, vector) with the vectors' used columns and their Shapley values, both dense, a bounded number of cells at a time."""
    forest = shared.value
    step = max(1, CELLS // max(1, len(forest.columns)))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            x = _dense(part.column(part.num_columns - 1), forest.columns)
            phi = np.zeros_like(x)
            for tree in tree_paths(forest):
                tree.add(x, phi)
            yield part, x, phi / len(forest.path)


def tree_paths(forest: ForestArrays) -> list[TreePaths]:
    """Built once for each copy of a forest, that is once per worker."""
    if not hasattr(forest, "_paths"):
        forest._paths = [TreePaths(forest, tree) for tree in range(len(forest.path))]
        left = TABLE_BYTES
        for tree in forest._paths:
            size = 8 * tree.share.size * 2 ** min(tree.share.shape[1], TABLE_WIDTH)
            tree.tabulated = tree.tabulated and size <= left
            left -= size if tree.tabulated else 0
    return forest._paths


def _named(model: IsolationForestModel, names: DataFrame) -> DataFrame:
    """(_at, feature, name) of the features the forest uses: at most trees * (max_samples - 1) rows."""
    wanted = names.sparkSession.createDataFrame([(i, int(c)) for i, c in enumerate(model.arrays.columns)], "_at int, feature int")
    return F.broadcast(wanted.join(names, "feature", "left"))


def shap_values(model: IsolationForestModel, df: DataFrame, names: DataFrame, key: str, features: str = "features") -> DataFrame:
    """Long table (key, feature, name, phi, x) for every row and every feature the forest splits on.

    The explained output is the mean path length: positive means "more like the labeled awards".
    Features the forest never uses have the value 0 and are not listed.
    """
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.arrays)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, phi in _blocks(shared, batches):
            offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v.ravel())) for v in (phi, x)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["key", "phi", "x"])

    rows = df.select(F.col(key).alias("key"), parts(df, features).alias("v"))
    explained = rows.mapInArrow(explain, f"key {dict(df.dtypes)[key]}, phi array<double>, x array<double>")
    long = explained.select(F.col("key").alias(key), F.posexplode(F.arrays_zip("phi", "x")).alias("_at", "_v"))
    return long.join(_named(model, names), "_at").select(key, "feature", "name", F.col("_v.phi").alias("phi"), F.col("_v.x").alias("x"))


def importance(model: IsolationForestModel, df: DataFrame, names: DataFrame, top: int = 20, features: str = "features") -> DataFrame:
    """``shap_importance`` without the long table: tasks add up absolute values and send one row per feature and task."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model.arrays)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(shared.value.columns)), 0
        for _, x, phi in _blocks(shared, batches):
            total, rows = total + np.abs(phi).sum(axis=0), rows + len(x)
        if rows:
            yield pa.RecordBatch.from_pydict({"_at": pa.array(range(len(total)), pa.int32()), "s": pa.array(total), "n": pa.array([rows] * len(total), pa.int64())})

    sums = df.select(parts(df, features).alias("v")).mapInArrow(add, "_at int, s double, n long")
    means = sums.groupBy("_at").agg((F.sum("s") / F.sum("n")).alias("mean_abs_phi"))
    return means.join(_named(model, names), "_at").select("feature", "name", "mean_abs_phi").orderBy(F.desc("mean_abs_phi"), "feature").limit(top)


def shap_importance(values: DataFrame, top: int = 20) -> DataFrame:
    """Features with the largest mean absolute Shapley value, from a long table."""
    return (
        values.groupBy("feature", "name").agg(F.avg(F.abs("phi")).alias("mean_abs_phi"))
        .orderBy(F.desc("mean_abs_phi"), "feature").limit(top)
    )


def shap_summary(values: DataFrame, top: int = 20) -> DataFrame:
    """Per-row Shapley values with the feature value, for the most important features only."""
    best = F.broadcast(shap_importance(values, top).select("feature", "mean_abs_phi"))  # ``top`` rows
    return values.join(best, "feature")
