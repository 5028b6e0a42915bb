"""Order statistics that stay distributed: first n rows, positions, exact percentiles, hash cuts.

A global window puts all rows into one task. These helpers use one only below a counted bound; above
it they sort by range and add per-partition offsets, or narrow down by counting.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import broadcast_if_small, checkpoint
from .filters import drop_placeholders

# Rows that one task may order or the driver may hold.
SMALL = 100_000
# Rows that every task may send to one task.
FEW = 1_000


def _sorted_parts(df: DataFrame, order: list[Column]) -> tuple[DataFrame, list[tuple[int, int]]]:
    """A range-sorted, materialised copy with its partition number, and rows per partition.

    The copy is checkpointed, so the numbers do not change between the jobs that use them.
    """
    stored = checkpoint(df.orderBy(*order)).withColumn("_part", F.spark_partition_id())
    sizes = stored.groupBy("_part").count().collect()
    return stored, sorted((row["_part"], row["count"]) for row in sizes)


def first_n(df: DataFrame, n: int, *order: Column, small: int = FEW) -> DataFrame:
    """The first ``n`` rows in the given order, whatever the size of ``n``.

    A plain limit sends ``n`` rows of every task to one task, so it is used for a few rows only.
    """
    order = list(order)
    if n <= small:
        return df.orderBy(*order).limit(n)
    stored, sizes = _sorted_parts(df, order)
    whole, left = [], n
    for part, count in sizes:
        if count > left:
            break
        whole.append(part)
        left -= count
    else:
        return stored.drop("_part")
    edge = (
        stored.where(F.col("_part") == part)
        .withColumn("_rank", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
        .where(F.col("_rank") <= left)
        .drop("_rank")
    )
    return stored.where(F.col("_part").isin(whole)).union(edge).drop("_part")


def positions(df: DataFrame, name: str, *order: Column, rows: int | None = None, small: int = SMALL) -> DataFrame:
    """Add the 0-based position of each row in the given order. ``rows`` is the row count if known."""
    order = list(order)
    rows = df.count() if rows is None else rows
    if rows <= small:
        return df.withColumn(name, (F.row_number().over(W.orderBy(*order)) - 1).cast("bigint"))
    stored, sizes = _sorted_parts(df, order)
    start, starts = 0, []
    for part, count in sizes:
        starts.append((part, start))
        start += count
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start bigint"))  # one row per partition
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return stored.join(offsets, "_part").withColumn(name, (rank + F.col("_start")).cast("bigint")).drop("_part", "_start")


def _kth(values: DataFrame, k: int, n: int, small: int) -> float:
    """Value with 0-based rank ``k`` among the ``n`` values of column x.

    Each round brackets the rank between two approximate percentiles, counts exactly what lies
    below, on and inside the bracket, and goes on with the part that holds the rank. A bracket holds
    under half a percent of the values, and equal values are settled by their count alone.
    """
    x = F.col("x")
    while n > small:
        low_share, high_share = max(0.0, k / n - 0.002), min(1.0, (k + 1) / n + 0.002)
        low, high = values.agg(F.percentile_approx(x, [low_share, high_share], 10_000).alias("b")).first()["b"]
        counts = values.agg(
            F.count_if(x < low).alias("below"),
            F.count_if(x == low).alias("at_low"),
            F.count_if((x > low) & (x < high)).alias("inside"),
            F.count_if((x == high) & (x > low)).alias("at_high"),
        ).first()
        if k < counts["below"]:
            values, n = values.where(x < low), counts["below"]
            continue
        k -= counts["below"]
        if k < counts["at_low"]:
            return low
        k -= counts["at_low"]
        if k < counts["inside"]:
            values, n = values.where((x > low) & (x < high)), counts["inside"]
            continue
        k -= counts["inside"]
        if k < counts["at_high"]:
            return high
        k -= counts["at_high"]
        values, n = values.where(x > high), n - sum(counts)
    for row in values.groupBy("x").count().orderBy("x").collect():
        if k < row["count"]:
            return row["x"]
        k -= row["count"]
    raise ValueError("rank beyond the values")


def percentile(df: DataFrame, column: str, share: float, small: int = SMALL) -> float | None:
    """Exact percentile with linear interpolation, without holding the values in one buffer.

    Runs jobs over ``df``: give it a stored or persisted table. Null and NaN are left out.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    n = values.count()
    if not n:
        return None
    place = (n - 1) * share
    k = min(math.floor(place), n - 1)
    low = _kth(values, k, n, small)
    weight = place - k
    if weight == 0:
        return low
    after = values.agg(F.count_if(F.col("x") <= low).alias("c"), F.min(F.when(F.col("x") > low, F.col("x"))).alias("m")).first()
    high = low if after["c"] > k + 1 else after["m"]
    return low + (high - low) * weight


# --- samples and splits by hash --------------------------------------------------------------

_DIGITS = 4  # hex digits of the md5 that form a bucket: 65,536 buckets


def _hash(seed: int, key: str | list[str]) -> Column:
    keys = [key] if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def exact_sample(df: DataFrame, n: int, key: str | list[str], seed: int = 42, small: int = FEW) -> DataFrame:
    """Exactly ``n`` rows (all rows when there are fewer), the same ones on every run.

    ``key`` should tell rows apart. Rows are taken in the order of md5(seed|key). Rows are counted, and a bound on the
    hash leaves ``n`` rows and a few more (8 standard deviations), of which the last ones are cut off by an ordering of
    these alone. Where keys repeat so much that the bound leaves too few, all rows are ordered.
    """
    keys = [key] if isinstance(key, str) else key
    hashed = df.withColumn("_hash", _hash(seed, keys))
    order = [F.col("_hash"), *[F.col(k) for k in keys]]
    total = hashed.count()
    if total <= n:
        return df
    bound = (n + 8.0 * math.sqrt(n) + 16.0) / total
    if bound < 1:
        near = hashed.where(F.col("_hash") < F.lit(f"{int(bound * 2**52):013x}"))
        if near.count() >= n:
            hashed = near
    return first_n(hashed, n, *order, small=small).drop("_hash")


def fixture_sample(df: DataFrame, n: int = 200, key: str | list[str] = "piid", seed: int = 42) -> DataFrame:
    """A test fixture: ``n`` awards that are not placeholders."""
    return exact_sample(drop_placeholders(df), n, key, seed)


def stratified_split(df: DataFrame, strata: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Add ``is_train``: per stratum, the first floor(share * rows) rows in the order of md5(seed|key).

    A stratum may hold most of the table, so it is never ordered as a whole. Rows per (stratum, hash
    bucket) are counted, which gives the bucket on the cut; rows in other buckets are settled by
    comparing bucket numbers and only the rows of that one bucket per stratum are ranked.
    """
    hashed = df.withColumn("_hash", _hash(seed, key)).withColumn(
        "_bucket", F.conv(F.substring("_hash", 1, _DIGITS), 16, 10).cast("int")
    )
    counts = hashed.groupBy(F.col(strata).alias("_s"), "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy("_s").orderBy("_bucket")
    quota = F.floor(F.lit(share) * F.sum("_n").over(W.partitionBy("_s")))
    upto = F.sum("_n").over(running)
    cuts = (
        counts.select("_s", "_bucket", "_n", quota.alias("_quota"), upto.alias("_upto"))
        .where((F.col("_upto") > F.col("_quota")) & (F.col("_upto") - F.col("_n") <= F.col("_quota")))
        .select("_s", F.col("_bucket").alias("_cut"), (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    # One row per stratum; measured, so that a stratum with most of the rows is not shuffled into one task.
    cuts = broadcast_if_small(checkpoint(cuts))
    placed = hashed.join(cuts, F.col(strata).eqNullSafe(F.col("_s"))).drop("_s")
    settled = placed.where(F.col("_bucket") != F.col("_cut")).withColumn("is_train", F.col("_bucket") < F.col("_cut"))
    rank = F.row_number().over(W.partitionBy(strata, "_bucket").orderBy("_hash", key))
    edge = placed.where(F.col("_bucket") == F.col("_cut")).withColumn("is_train", rank <= F.col("_left"))
    return settled.unionByName(edge).drop("_hash", "_bucket", "_cut", "_left")

