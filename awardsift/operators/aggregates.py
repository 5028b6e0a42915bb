"""Aggregations over award and score tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, percentage, truncate
from ..session import checkpoint, ship_package
from .ranks import first_n, positions

SWEEP_STEPS = 50


def rollup_awards(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per award: largest value, latest end date, first non-null texts in the given order.

    Rows without an id are dropped. All aggregates combine before the shuffle, so an id with very
    many rows sends one row per task.
    """
    at = F.struct(*order)

    def first(name: str) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), at)).alias(name)

    return (
        df.where(F.col("piid").isNotNull())
        .groupBy(*keys)
        .agg(
            first("description"), F.max("value").alias("value"), F.max("end_date").alias("end_date"),
            first("vendor"), first("agency"),
        )
    )


def top_categories(counts: DataFrame, share: float = 0.2) -> tuple[DataFrame, int]:
    """The most frequent ``share`` of the categories, at least one, ties by name; and how many that is.

    Counts are stored first: the number of categories fixes how many are taken, and the list may be
    long, so it goes through ``first_n`` rather than a window over all categories.
    """
    stored = checkpoint(counts)
    n = max(1, int(stored.count() * share))
    return first_n(stored, n, F.col("n").desc(), F.col("category")), n


def agency_rates(scored: DataFrame, flag: str = "for_review", agency: str = "agency", top: int = 15) -> DataFrame:
    """Agencies with the highest share of flagged awards."""
    flagged = F.count_if(F.col(flag))
    return (
        scored.where(F.col(agency).isNotNull())
        .groupBy(agency)
        .agg(flagged.alias("anomaly_count"), F.count(flag).alias("total_count"))
        .withColumn("anomaly_percentage", percentage(F.col("anomaly_count"), F.col("total_count")))
        .orderBy(F.desc("anomaly_percentage"), F.col(agency))
        .limit(top)
    )


def run_counts(scored: DataFrame) -> DataFrame:
    """Totals of a scoring run in one row."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomalous_by_contamination").alias("flagged_by_contamination"),
        F.count_if("for_review").alias("flagged_for_review"),
        F.coalesce(F.try_divide(F.count_if("for_review"), F.count(F.lit(1))), F.lit(0.0)).alias("review_rate"),
    )


def run_summary(outputs: DataFrame) -> DataFrame:
    """department -> {award type -> path}; empty and null paths are left out.

    A department has one path per award type, so the collected list is as short as the type list.
    """
    return (
        outputs.where(F.length("path") > 0)
        .groupBy("department")
        .agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("award_type", "path")))).alias("paths"))
    )


def confusion_metrics(flagged_true: Column, flagged_pred: Column) -> list[Column]:
    """Precision, recall and F1 of the flagged class; 0 where the denominator is 0."""
    hit = F.count_if(flagged_true & flagged_pred)
    predicted, real = F.count_if(flagged_pred), F.count_if(flagged_true)
    return [
        F.coalesce(F.try_divide(hit, predicted), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(hit, real), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * hit, predicted + real), F.lit(0.0)).alias("f1_score"),
    ]


def evaluate(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Metrics of labels 1 / -1, where -1 is the flagged class."""
    return df.agg(*confusion_metrics(F.col(y_true) == -1, F.col(y_pred) == -1))


def threshold_metrics(df: DataFrame, score: str, y_true: str, thresholds: list[float]) -> DataFrame:
    """Metrics per threshold in one pass: rows are counted by how many thresholds they exceed.

    The label -1 is the flagged class. What leaves the map side is one row per number of exceeded
    thresholds; the counts per threshold are running sums over that table.
    """
    grid = sorted(set(thresholds))
    levels = F.array(*[F.lit(float(t)) for t in grid])
    exceeded = F.size(F.filter(levels, lambda t: F.col(score) > t))
    counts = df.groupBy(exceeded.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(y_true) == -1).alias("bad")
    )
    every = df.sparkSession.createDataFrame([(i, t) for i, t in enumerate(grid, 1)], "k int, threshold double")
    zero = every.select("k", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bad"))
    filled = counts.union(zero).groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    down = W.orderBy(F.desc("k"))  # at most len(thresholds) + 1 rows
    sums = filled.select(
        "k", F.sum("n").over(down).alias("predicted"), F.sum("bad").over(down).alias("hit"),
        F.sum("bad").over(W.partitionBy()).alias("real"),
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    return sums.join(F.broadcast(every), "k").select(
        "threshold",
        ratio(F.col("hit"), F.col("predicted")).alias("precision"),
        ratio(F.col("hit"), F.col("real")).alias("recall"),
        ratio(2 * F.col("hit"), F.col("predicted") + F.col("real")).alias("f1_score"),
    )


def score_range(df: DataFrame, score: str = "anomaly_score") -> DataFrame:
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, each as a scalar subquery named once."""
    return df.withColumns({name: stats.select(name).scalar() for name in stats.columns})


def sweep(df: DataFrame, score: str = "anomaly_score", steps: int = SWEEP_STEPS) -> DataFrame:
    """Rows above each of ``steps`` equally spaced thresholds between the lowest and highest score.

    A row's place in the grid is computed from its score, so the table shrinks to ``steps`` + 1 counts
    on the map side; counts above a threshold are running sums over those.
    """
    values = df.select(F.col(score).alias("s")).where("s is not null")
    ends = values.agg(F.min("s").alias("low"), F.max("s").alias("high"))
    last = steps - 1
    low, high, width = F.col("low"), F.col("high"), (F.col("high") - F.col("low")) / F.lit(float(last))

    def threshold(i: Column) -> Column:
        return F.when(i == last, high).otherwise(low + i * width)

    place = F.least(F.floor(F.coalesce(F.try_divide(F.col("s") - low, width), F.lit(0.0))), F.lit(last))
    # Rounding can put the computed place off by one: compare with the thresholds around it.
    around = [F.when((i >= 0) & (i <= last) & (threshold(i) < F.col("s")), 1).otherwise(0)
              for i in (F.col("i") - 1, F.col("i"), F.col("i") + 1)]
    exceeded = F.greatest(F.col("i") - 1, F.lit(0)) + around[0] + around[1] + around[2]
    counts = _with_stats(values, ends).withColumn("i", place).groupBy(exceeded.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(1, steps + 1).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("bigint").alias("n"))
    filled = counts.union(every).groupBy("k").agg(F.sum("n").alias("n"))
    flagged = F.sum("n").over(W.orderBy(F.desc("k")))  # at most steps + 1 rows
    grid = _with_stats(filled.select("k", flagged.alias("flagged")).where("k > 0"), ends)
    return grid.select((F.col("k") - 1).alias("step"), threshold(F.col("k") - 1).alias("threshold"), "flagged")


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based equal-width bin; the last one includes the maximum, everything is in bin 0 when low = high."""
    place = F.floor(F.coalesce(F.try_divide((x - low) * bins, high - low), F.lit(0.0)))
    return F.least(place, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts per equal-width bin; the last bin includes the maximum, empty bins are kept."""
    values = df.select(F.col(column).alias("x")).where("x is not null")
    ends = values.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    low, high = F.col("low"), F.col("high")
    counts = _with_stats(values, ends).groupBy(_bin(F.col("x"), low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"))
    filled = _with_stats(counts.union(every).groupBy("bin").agg(F.sum("n").alias("n")), ends)
    width = (high - low) / F.lit(float(bins))
    return filled.select("bin", (low + F.col("bin") * width).alias("bin_start"), (low + (F.col("bin") + 1) * width).alias("bin_end"), "n")


# Bins of the density in one bandwidth, and the highest power that is kept of each.
BINS_PER_WIDTH = 8
ORDER = 8


def density(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density at equally spaced points from minimum to maximum, Scott's bandwidth.

    Range and bandwidth are fetched first. Rows are then summed up by narrow bins, each with the powers of its rows' distances from the middle
    of the bin up to ``ORDER`` (a fast Gauss transform), and only the bins that hold rows meet the points: the cost is rows + bins x points.
    A row's kernel is off by less than (1 / (2 * BINS_PER_WIDTH)) ** (ORDER + 1) / sqrt((ORDER + 1)!), some 3e-14.
    """
    values = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    low, high, n, spread = values.agg(F.min("x"), F.max("x"), F.count(F.lit(1)), F.stddev_samp("x")).first()
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    if not spread:
        return grid.select("i", F.lit(low).cast("double").alias("point"), F.lit(None).cast("double").alias("density"))
    width, step = spread * n**-0.2, (high - low) / (points - 1)
    ship_package(df.sparkSession)
    wide = width / BINS_PER_WIDTH
    place = F.floor((F.col("x") - F.lit(low)) / F.lit(wide)).alias("bin")
    off = (F.col("x") - F.lit(low) - (F.col("bin") + 0.5) * F.lit(wide)) / F.lit(width)
    powers, power = [], F.lit(1.0)
    for k in range(ORDER + 1):
        powers.append(F.sum(power).alias(f"m{k}"))
        power = power * F.col("u")
    bins = values.select("x", place).select("bin", off.alias("u")).groupBy("bin").agg(*powers)
    sums = bins.mapInArrow(kernel_sums(low, wide, step, width, points), "i int, s double")
    filled = sums.union(grid.select("i", F.lit(0.0))).groupBy("i").agg(F.sum("s").alias("s"))
    scale = n * width * (2 * math.pi) ** 0.5
    return filled.select("i", (F.lit(low) + F.col("i") * F.lit(step)).alias("point"), (F.col("s") / F.lit(scale)).alias("density"))


def kernel_sums(low: float, wide: float, step: float, width: float, points: int, block: int = 1024):
    """Every bin's kernels at every point: exp(-d * d / 2) times the sum of its powers with Hermite polynomials of the distance d."""
    def add(batches):
        place = low + np.arange(points) * step
        total, seen = np.zeros(points), False
        for batch in batches:
            every = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for at in range(0, batch.num_rows, block):
                middle, *sums = (c[at : at + block, None] for c in every)
                d = (place[None, :] - (low + (middle + 0.5) * wide)) / width
                before, now, series, factor = np.zeros_like(d), np.ones_like(d), np.zeros_like(d), 1.0
                for k, m in enumerate(sums):
                    series += m / factor * now
                    before, now, factor = now, d * now - k * before, factor * (k + 1)
                total, seen = total + (np.exp(-0.5 * d * d) * series).sum(axis=0), True
        if seen:
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(points), pa.int32()), "s": pa.array(total)})
    return add


def value_score_grid(
    df: DataFrame, bins: int = 20, score: str = "anomaly_score", value: str = "normalized_value", flag: str = "for_review",
    log_scale: bool = True,
) -> DataFrame:
    """Awards per (score bin, value bin, flag). Values are on a log scale only if all are above 0."""
    base = df.select(F.col(score).alias("s"), F.col(value).alias("v"), F.col(flag).alias(flag))
    use_log = F.lit(log_scale) & F.bool_and(F.col("v") > 0)
    low, high = F.min("v"), F.max("v")
    ends = base.agg(
        F.min("s").alias("s0"), F.max("s").alias("s1"), use_log.alias("log_scale"),
        F.when(use_log, F.ln(low)).otherwise(low).alias("v0"), F.when(use_log, F.ln(high)).otherwise(high).alias("v1"),
    )
    scaled = F.when(F.col("log_scale"), F.ln("v")).otherwise(F.col("v"))
    return _with_stats(base, ends).groupBy(
        _bin(F.col("s"), F.col("s0"), F.col("s1"), bins).alias("score_bin"),
        _bin(scaled, F.col("v0"), F.col("v1"), bins).alias("value_bin"), flag, "log_scale",
    ).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, n: int, score: str = "anomaly_score", tie: str = "piid") -> DataFrame:
    """The ``n`` best scores with their rank from 1; only those n rows are numbered."""
    order = [F.desc(score), F.col(tie)]
    best = positions(first_n(df, n, *order), "rank", *order, rows=n)
    return best.withColumn("rank", (F.col("rank") + 1).cast("int"))


def top_n(
    df: DataFrame, n: int = 20, score: str = "anomaly_score", text: str = "clean_description", value: str = "normalized_value",
) -> DataFrame:
    """Top awards with the label shown next to each: '$1,234: text cut to 50'."""
    labels = {"label": F.concat(money(F.col(value)), F.lit(": "), truncate(F.col(text)))}
    return ranked(df, n, score).withColumns(labels)


def top_summary(df: DataFrame, n: int = 5) -> DataFrame:
    """The closing summary of a run: rank, score, id, agency and value of the best awards."""
    return ranked(df, n).select("rank", "anomaly_score", "piid", "agency", "normalized_value")


def by_score(df: DataFrame, score: str = "anomaly_score", tie: str = "piid", stored: bool = False) -> DataFrame:
    """All rows by falling score: a range sort over all tasks; the id spreads equal scores.

    Very many rows may share both, say copies of one award. In a ``stored`` table a row's number does not
    change between the passes of the sort, so it can spread those as well.
    """
    keys = [F.desc(score), F.col(tie)]
    if not stored:
        return df.orderBy(*keys)
    return df.withColumn("_row", F.monotonically_increasing_id()).orderBy(*keys, "_row").drop("_row")


def page(df: DataFrame, order: str, key: str, size: int = 100, max_pages: int = 1) -> DataFrame:
    """Newest-first pages 1..max_pages. Only size * max_pages rows are ordered and numbered."""
    by = [F.desc(order), F.col(key)]
    wanted = size * max_pages
    rows = positions(first_n(df, wanted, *by), "_at", *by, rows=wanted)
    return rows.withColumn("page", (F.floor(F.col("_at") / size) + 1).cast("int")).drop("_at")


def page_cutoff(pages: DataFrame, max_pages: int, number: str = "page", items: str = "n_items", total: str = "pages") -> DataFrame:
    """Pages before the first empty one, up to ``max_pages`` and up to the announced number of pages.

    ``items`` is the number of records on the page; none or null means empty.
    """
    empty = pages.where(F.coalesce(F.col(items), F.lit(0)) <= 0).agg(F.min(number).alias("p"))
    final = pages.where((F.col(total) > 0) & (F.col(number) >= F.col(total))).agg(F.min(number).alias("p"))
    return pages.where(
        (F.col(number) < F.coalesce(empty.scalar(), F.lit(2**31 - 1)))
        & (F.col(number) <= F.coalesce(final.scalar(), F.lit(2**31 - 1)))
        & (F.col(number) <= max_pages)
    )
