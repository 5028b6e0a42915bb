"""Correlation and principal components of feature vectors.

Up to ``MAX_WIDTH`` features both use a matrix of features x features on the driver. Wider vectors go to ``wide``, which has none:
there components are the first ``WIDE_COMPONENTS``, and only pairs above a limit are listed.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import wide
from .vectors import parts

MAX_WIDTH = 4096
WIDE_COMPONENTS = 50


def _shape(df: DataFrame, features: str) -> tuple[int, int]:
    """Number of rows and vector width."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.max(parts(df, features)["size"]).alias("sparse"),
                 F.max(F.when(parts(df, features)["type"] == 1, F.size(parts(df, features)["values"]))).alias("dense")).first()
    return row["n"], max(row["sparse"] or 0, row["dense"] or 0)


def pca_variance(df: DataFrame, features: str = "features") -> DataFrame:
    """Explained and cumulative variance per component, and the first component that reaches 95 %.

    Empty when there are fewer than 2 rows or features. Above ``MAX_WIDTH`` features it lists the first ``WIDE_COMPONENTS``.
    """
    spark = df.sparkSession
    kind = "component int, variance_ratio double"
    n, width = _shape(df, features)
    if width > MAX_WIDTH:
        return wide.variance(df, features, WIDE_COMPONENTS).drop("error_bound")
    rows = []
    if n >= 2 and width >= 2:
        ratios = PCA(k=min(n, width), inputCol=features, outputCol="_pc").fit(df).explainedVariance
        rows = [(i, float(r)) for i, r in enumerate(ratios, 1)]
    running = F.sum("variance_ratio").over(W.orderBy("component").rowsBetween(W.unboundedPreceding, 0))  # <= width rows
    table = spark.createDataFrame(rows, kind).withColumn("cumulative_ratio", running)
    reached = F.min(F.when(F.col("cumulative_ratio") >= 0.95, F.col("component"))).over(W.partitionBy())
    return table.withColumn("components_for_95", reached)


def pca_2d(df: DataFrame, features: str = "features") -> DataFrame:
    """Add pc1 and pc2, the first two principal components of the centred vectors (signs are arbitrary)."""
    n, width = _shape(df, features)
    if width > MAX_WIDTH:
        return wide.project(df, features)
    if n < 2 or width < 2:
        return df.withColumns({"pc1": F.lit(None).cast("double"), "pc2": F.lit(None).cast("double")}).limit(0)
    centred = StandardScaler(withMean=True, withStd=False, inputCol=features, outputCol="_centred").fit(df).transform(df)
    placed = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(centred).transform(centred)
    point = vector_to_array("_pc")
    return placed.withColumns({"pc1": point[0], "pc2": point[1]}).drop("_centred", "_pc")


def correlations(df: DataFrame, features: str = "features") -> DataFrame:
    """Pearson correlation of every pair of features (i > j); NaN for constant features."""
    n, width = _shape(df, features)
    if width > MAX_WIDTH:
        raise ValueError(f"all pairs of {width} features need a matrix of {width} x {width}; use correlation_pairs above {MAX_WIDTH}")
    if n < 2 or width < 2:
        return df.sparkSession.createDataFrame([], "i int, j int, r double")
    matrix = Correlation.corr(df, features).select(F.unwrap_udt(F.col(f"pearson({features})"))["values"].alias("v"))
    cells = matrix.select(F.posexplode("v").alias("at", "r"))
    return cells.select(
        F.floor(F.col("at") / width).cast("int").alias("i"), (F.col("at") % width).cast("int").alias("j"), "r"
    ).where("j < i")


def correlation_pairs(df: DataFrame, features: str = "features", limit: float = 0.9) -> DataFrame:
    """Pairs with an absolute correlation above ``limit``; a constant feature is never part of one."""
    if _shape(df, features)[1] > MAX_WIDTH:
        return wide.correlated(df, features, limit)
    return correlations(df, features).where(~F.isnan("r") & (F.abs("r") > limit))

