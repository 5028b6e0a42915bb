"""Isolation forest as a Spark job (Liu, Ting and Zhou, 2008).

Fitted on the labeled awards, so a HIGH score means "like the labeled ones". Drawing the samples is a
hash filter plus one small shuffle, each tree is one group of at most ``max_samples`` rows, and scoring
is a map over Arrow batches with the node table broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import md5
from math import ceil, log, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import schema
from ..session import broadcast_if_small, checkpoint, ship_package, store
from .ranks import positions
from .scores import between, neighbours, summarise
from .vectors import parts

# Fixed value: the Euler-Mascheroni constant, from the average depth of an unsuccessful tree search.
EULER = 0.5772156649015329
# A column whose values differ by no more than this inside a node is not split on.
FLAT = 1e-7
MAX_SAMPLES = 256
REVIEW_SHARE = 0.9
BLOCK = 2048  # rows made dense at a time


def average_path(n: int) -> float:
    """Average path length that ``n`` rows in a leaf stand for."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts: the same on every machine, in Python and in SQL."""
    text = F.concat_ws("|", *[part.cast("string") for part in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") * F.lit(2.0**-52)


def _fraction(*parts: object) -> float:
    return int(md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) * 2.0**-52


def numbered_rows(df: DataFrame, features: str, key: list[str] | None) -> tuple[DataFrame, int]:
    """A stored table (row_id, features) and its row count; ids follow from the data alone.

    An id is the ``key``, which has to tell rows apart, or the md5 of the feature vector. Copies of a vector are
    numbered, and since they are equal it does not matter which copy gets which number.
    """
    own = F.concat_ws("|", *[F.col(k).cast("string") for k in key]) if key else F.md5(parts(df, features).cast("string"))
    rows = store(df.select(own.alias("row_id"), parts(df, features).alias("features")))
    if key:
        return rows, rows.count()
    n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct("row_id")).first()
    if n == distinct:
        return rows, n
    placed = positions(rows.withColumn("_row", F.monotonically_increasing_id()), "_at", F.col("row_id"), F.col("_row"), rows=n)
    first = broadcast_if_small(checkpoint(placed.groupBy("row_id").agg(F.min("_at").alias("_first"))))
    copy = F.when(F.col("_at") > F.col("_first"), F.concat_ws("#", "row_id", (F.col("_at") - F.col("_first")).cast("string")))
    return store(placed.join(first, "row_id").select(F.coalesce(copy, "row_id").alias("row_id"), "features")), n


def tree_draws(rows: DataFrame, n: int, trees: int, samples: int, seed: int) -> DataFrame:
    """``samples`` rows per tree without replacement: (tree_id, draw, features).

    Row and tree hash to a fraction. Only fractions below a bound that leaves a few more rows than
    needed (8 standard deviations) are kept, inside the row, so about ``trees * samples`` rows are made and
    shuffled, never ``trees * n``, and the ranking per tree sees a few hundred rows.
    """
    bound = min(1.0, (samples + 8.0 * sqrt(samples) + 16.0) / n)
    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(
        t.alias("tree_id"), fraction(F.lit(seed), t, F.col("row_id")).alias("draw")))
    return (
        rows.select("row_id", "features", F.explode(F.filter(every, lambda x: x["draw"] < F.lit(bound))).alias("_d"))
        .select("row_id", "features", "_d.tree_id", "_d.draw")
        .withColumn("_rank", F.row_number().over(W.partitionBy("tree_id").orderBy("draw", "row_id")))
        .where(F.col("_rank") <= samples)
        .select("tree_id", "draw", "row_id", parts(rows, "features").alias("features"))
    )


def _dense(vectors: pa.StructArray, columns: np.ndarray) -> np.ndarray:
    """The given columns of a batch of ML vectors (dense or sparse) as a matrix."""
    values, indices = vectors.field("values"), vectors.field("indices")
    out = np.zeros((len(vectors), len(columns)))
    starts = np.diff(values.offsets.to_numpy())
    flat = values.flatten().to_numpy(zero_copy_only=False)
    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    sizes = np.where(dense, starts, 0)
    size = int(sizes.max()) if dense.any() else 0
    row_of = np.repeat(np.arange(len(vectors)), starts)
    if dense.any():
        out[dense] = flat[dense[row_of]].reshape(-1, size)[:, columns]
    if not dense.all():
        index = indices.flatten().to_numpy(zero_copy_only=False)
        place = np.full(int(max(index.max(initial=0), columns.max(initial=0))) + 1, -1)
        place[columns] = np.arange(len(columns))
        sparse = ~dense[row_of]
        at = place[index]
        used = at >= 0
        out[row_of[sparse][used], at[used]] = flat[sparse][used]
    return out


def _used_columns(vectors: pa.StructArray) -> np.ndarray:
    """Columns of a batch that may differ from zero."""
    found = [np.unique(vectors.field("indices").flatten().to_numpy(zero_copy_only=False))]
    dense = vectors.field("type").to_numpy(zero_copy_only=False) == 1
    if dense.any():
        found.append(np.arange(int(np.diff(vectors.field("values").offsets.to_numpy())[dense].max())))
    return np.unique(np.concatenate(found)).astype(np.int64)


def _grow(x: np.ndarray, columns: np.ndarray, seed: int, tree: int) -> list[dict]:
    """Node rows of one tree over a small matrix: random column, uniform split, limited depth.

    Nodes are numbered as in a heap (children of i: 2i + 1 and 2i + 2). Both choices of a node come from the md5 of
    seed, tree and node, so neither the order of rows nor the number of tasks matters.
    """
    limit = ceil(log2(max(len(x), 2)))
    nodes: list[dict] = []
    todo = [(np.arange(len(x)), 0, 0)]
    while todo:
        rows, depth, node = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        varied = np.flatnonzero(high > low + FLAT)
        leaf = depth >= limit or len(rows) < 2 or not len(varied)
        entry = {"node_id": node, "is_leaf": leaf, "feature": -1, "split": 0.0, "left": -1, "right": -1,
                 "depth": depth, "n_samples": len(rows), "path_len": depth + average_path(len(rows)) if leaf else 0.0}
        nodes.append(entry)
        if leaf:
            continue
        pick = varied[int(_fraction(seed, tree, node, "feature") * len(varied))]
        split = low[pick] + _fraction(seed, tree, node, "split") * (high[pick] - low[pick])
        if split >= high[pick]:
            split = low[pick]
        entry |= {"feature": int(columns[pick]), "split": float(split), "left": 2 * node + 1, "right": 2 * node + 2}
        goes_left = x[rows, pick] <= split
        todo.append((rows[~goes_left], depth + 1, 2 * node + 2))
        todo.append((rows[goes_left], depth + 1, 2 * node + 1))
    return nodes


def build_trees(draws: DataFrame, seed: int) -> DataFrame:
    """Node table from the drawn rows; one group per tree."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("draw", "ascending"), ("row_id", "ascending")]).combine_chunks()
        tree = table.column("tree_id")[0].as_py()
        vectors = table.column("features").combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.chunk(0)
        columns = _used_columns(vectors)
        nodes = _grow(_dense(vectors, columns), columns, seed, tree)
        fields = [
            ("tree_id", pa.int32()), ("node_id", pa.int32()), ("is_leaf", pa.bool_()), ("feature", pa.int32()),
            ("split", pa.float64()), ("left", pa.int32()), ("right", pa.int32()), ("depth", pa.int32()),
            ("n_samples", pa.int64()), ("path_len", pa.float64()),
        ]
        return pa.Table.from_pylist([{"tree_id": tree, **node} for node in nodes], schema=pa.schema(fields))

    ship_package(draws.sparkSession)
    return draws.groupBy("tree_id").applyInArrow(build, schema.FOREST)


@dataclass
class ForestArrays:
    """The node table as padded arrays, columns renumbered to those the forest splits on."""

    columns: np.ndarray     # features used, ascending
    feature: np.ndarray     # trees x nodes, index into columns
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    cover: np.ndarray       # rows of the sample that reached the node
    leaf: np.ndarray
    depth: int

    @classmethod
    def collect(cls, nodes: DataFrame) -> ForestArrays:
        """Bring the forest to the driver: at most 2 * max_samples - 1 rows per tree, whatever the data."""
        table = nodes.toPandas().sort_values(["tree_id", "node_id"], ignore_index=True)
        t = np.unique(table["tree_id"], return_inverse=True)[1]
        starts = np.searchsorted(t, np.arange(t[-1] + 1))
        n = np.arange(len(t)) - starts[t]  # node numbers may have gaps: a node's place among its tree's
        number = table["node_id"].to_numpy(np.int64)
        wide = int(number.max()) + 1
        shape = (len(starts), int(n.max()) + 1)
        inner = ~table["is_leaf"].to_numpy(dtype=bool)
        columns = np.unique(table["feature"].to_numpy()[inner]).astype(np.int64)
        stay = np.broadcast_to(np.arange(shape[1]), shape)
        arrays = {"feature": np.zeros(shape, int), "split": np.full(shape, np.inf), "left": stay.copy(), "right": stay.copy(),
                  "path": np.zeros(shape), "cover": np.zeros(shape), "leaf": np.zeros(shape, bool)}
        ti, ni = t[inner], n[inner]
        arrays["feature"][ti, ni] = np.searchsorted(columns, table["feature"].to_numpy()[inner])
        arrays["split"][ti, ni] = table["split"].to_numpy()[inner]
        for name in ("left", "right"):
            arrays[name][ti, ni] = np.searchsorted(t * wide + number, ti * wide + table[name].to_numpy(np.int64)[inner]) - starts[ti]
        arrays["path"][t, n] = table["path_len"]
        arrays["cover"][t, n] = table["n_samples"]
        arrays["leaf"][t, n] = ~inner
        return cls(columns=columns, depth=int(table["depth"].max()), **arrays)

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row of a matrix over ``columns``: all trees descend level by level."""
        trees, width = self.feature.shape
        base = np.arange(trees) * width
        at = np.broadcast_to(base, (len(x), trees))
        feature, split = self.feature.ravel(), self.split.ravel()
        children = np.stack(((self.right + base[:, None]).ravel(), (self.left + base[:, None]).ravel()), axis=1).ravel()
        if not len(self.columns):
            x = np.zeros((len(x), 1))
        cells, rows = np.ascontiguousarray(x).ravel(), (np.arange(len(x)) * x.shape[1])[:, None]
        for _ in range(self.depth):
            below = cells.take(feature.take(at) + rows) <= split.take(at)
            at = children.take(2 * at + below)
        return self.path.ravel().take(at).mean(axis=1)


def mean_path_length(spark: SparkSession, forest: ForestArrays, features: Column, wrapped: bool = True) -> Column:
    """Mean path length per vector, or per bare struct. Only the vector goes to Python, other columns stay in the JVM."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("double")
    def walk(vectors: pa.Array) -> pa.Array:
        model = shared.value
        found = []
        for at in range(0, len(vectors), BLOCK):
            found.append(model.mean_path(_dense(vectors.slice(at, BLOCK), model.columns)))
        return pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return walk(F.unwrap_udt(features) if wrapped else features)


def with_mean_path(df: DataFrame, forest: ForestArrays, struct: Column, out: str) -> DataFrame:
    """Add the mean path length of a bare vector struct with column functions alone, no Python worker.

    The forest is one broadcast row beside every row, bounded by trees and ``max_samples``. For clusters whose tasks have no
    Python, and for vectors with few values: higher-order functions are interpreted, so large forests walk faster in ``mean_path_length``.
    """
    trees = [{"feature": f.tolist(), "split": s.tolist(), "left": left.tolist(), "right": right.tolist(), "path": p.tolist()} for f, s, left, right, p in zip(
        forest.feature, forest.split, forest.left, forest.right, forest.path)]
    kind = "trees array<struct<feature: array<int>, split: array<double>, left: array<int>, right: array<int>, path: array<double>>>, used array<int>"
    one = df.sparkSession.createDataFrame([(trees, forest.columns.tolist())], kind).select(F.struct("trees", "used").alias("_forest"))
    found = F.col("_forest")
    values, steps = struct["values"], F.sequence(F.lit(1), F.lit(max(forest.depth, 1)))

    def value(column: Column) -> Column:
        at = F.when(struct["type"] == 1, column).otherwise(F.array_position(struct["indices"], column).cast("int") - 1)
        return F.coalesce(F.get(values, at), F.lit(0.0))

    def walk(x: Column) -> Column:
        def down(tree: Column) -> Column:
            def step(node: Column, _: Column) -> Column:
                below = F.coalesce(F.get(x, F.get(tree["feature"], node)), F.lit(0.0)) <= F.get(tree["split"], node)
                return F.when(below, F.get(tree["left"], node)).otherwise(F.get(tree["right"], node))

            return F.get(tree["path"], F.aggregate(steps, F.lit(0), step))

        return F.aggregate(found["trees"], F.lit(0.0), lambda total, tree: total + down(tree)) / F.lit(float(len(trees)))

    # bound to a name by the outer function, so that the used values of a row are looked up once
    path = F.get(F.transform(F.array(F.transform(found["used"], value)), walk), 0)
    return df.crossJoin(F.broadcast(one)).withColumn(out, path).drop("_forest")


def score_from_path(path: Column, samples: int, offset: float = 0.0) -> Column:
    """-2^(-path / c(samples)) - offset; higher means deeper, hence more like the sample."""
    return -F.pow(F.lit(2.0), -path / F.lit(average_path(samples) or 1.0)) - F.lit(float(offset))


def flag_columns(score: Column, threshold: float) -> dict[str, Column]:
    return {"is_anomalous_by_contamination": score >= 0, "for_review": score > F.lit(float(threshold))}


def label_columns(score: Column, threshold: float) -> dict[str, Column]:
    """Labels 1 / -1: by contamination (-1 below 0) and by threshold (-1 above it)."""
    return {
        "label_by_contamination": F.when(score >= 0, 1).otherwise(-1),
        "label_by_threshold": F.when(score > F.lit(float(threshold)), -1).otherwise(1),
    }


@dataclass
class IsolationForestModel:
    nodes: DataFrame
    samples: int
    offset: float
    threshold: float
    arrays: ForestArrays
    summary: DataFrame | None = None  # of the raw scores it was fitted on, see ``scores``

    @classmethod
    def fit(
        cls, df: DataFrame, features: str = "features", n_estimators: int = 100, max_samples: int = MAX_SAMPLES,
        contamination: float = 0.1, seed: int = 42, key: list[str] | None = None,
    ) -> IsolationForestModel:
        """Forest, offset (``contamination`` percentile of the raw scores) and review threshold (90th percentile).

        The result depends on the rows and the seed alone, not on their order or partitioning (see ``numbered_rows``).
        """
        rows, n = numbered_rows(df, features, key)
        if n == 0:
            raise ValueError("cannot fit a forest on an empty table")
        samples = min(max_samples, n)
        nodes = checkpoint(build_trees(tree_draws(rows, n, n_estimators, samples, seed), seed))
        arrays = ForestArrays.collect(nodes)
        path = mean_path_length(df.sparkSession, arrays, F.col("features"), wrapped=False)
        raw = checkpoint(rows.select(score_from_path(path, samples).alias("raw")))
        summary = checkpoint(summarise(raw, "raw"))
        ends, (low, high, weight) = neighbours(raw, "raw", [contamination, REVIEW_SHARE], summary)
        offset = between(*ends)
        return cls(nodes, samples, offset, between(low - offset, high - offset, weight), arrays, summary)

    def score(self, df: DataFrame, features: str = "features", out: str = "anomaly_score", python: bool = True) -> DataFrame:
        """Add the score; without ``python`` the trees are walked by column functions."""
        struct = parts(df, features)
        if not python:
            walked = with_mean_path(df, self.arrays, struct, "_path")
            return walked.withColumn(out, score_from_path(F.col("_path"), self.samples, self.offset)).drop("_path")
        path = mean_path_length(df.sparkSession, self.arrays, struct, wrapped=False)
        return df.withColumn(out, score_from_path(path, self.samples, self.offset))

    def flags(self, scored: DataFrame, threshold: float | None = None, score: str = "anomaly_score") -> DataFrame:
        """Both flags; a threshold given here overrides the fitted one."""
        return scored.withColumns(flag_columns(F.col(score), self.threshold if threshold is None else threshold))

    def labels(self, scored: DataFrame, threshold: float | None = None, score: str = "anomaly_score") -> DataFrame:
        return scored.withColumns(label_columns(F.col(score), self.threshold if threshold is None else threshold))
