"""Score summaries: stated rank error, merging, exact percentiles in few passes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from awardsift.operators import scores
from awardsift.operators.ranks import percentile

SHARES = [0.0, 0.1, 0.37, 0.5, 0.9, 0.999, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(i % 7, float(v) if v is not None else None) for i, v in enumerate(values)], "batch int, s double").repartition(5)


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    return np.concatenate([rng.normal(size=6000), np.full(5000, 0.25), np.full(3000, -1.5), rng.exponential(40, 2000)])


def test_exact_percentiles_on_every_path(spark, skewed):
    rows = frame(spark, [None, float("nan"), *skewed]).cache()
    expected = np.percentile(skewed, [100 * s for s in SHARES])
    for small, size in ((100_000, scores.SIZE), (50, scores.SIZE), (20, 64)):  # 64: a coarse sketch, more passes
        assert scores.percentiles(rows, "s", SHARES, size=size, small=small) == pytest.approx(expected, rel=1e-12), (small, size)
    assert scores.percentiles(rows, "s", [0.1, 0.9]) == [percentile(rows, "s", 0.1), percentile(rows, "s", 0.9)]


def test_two_jobs_for_all_percentiles(spark, skewed):
    rows = frame(spark, skewed).cache()
    rows.count()
    context = spark.sparkContext
    context.setJobGroup("percentiles", "")
    scores.percentiles(rows.coalesce(1), "s", SHARES)
    stages = {s for j in context.statusTracker().getJobIdsForGroup("percentiles") for s in context.statusTracker().getJobInfo(j).stageIds}
    context.setJobGroup("", "")
    reads = sum(1 for s in stages if (info := context.statusTracker().getStageInfo(s)) and info.numCompletedTasks)
    assert 2 <= reads <= 7  # summary and fetch, with the shuffles behind them


def test_merged_batches_keep_the_error(spark, skewed):
    rows = frame(spark, skewed)
    parts = scores.summarise(rows, "s", ["batch"], size=200)
    whole = scores.merge(parts, size=200).first()
    assert (whole.n, whole.low, whole.high) == (len(skewed), skewed.min(), skewed.max())
    merged = spark.createDataFrame([whole], scores.SUMMARY)
    for row in scores.estimate(merged, SHARES).collect():
        below, upto = (skewed < row.estimate).mean(), (skewed <= row.estimate).mean()
        assert below - 3 * scores.rank_error(200) <= row.share <= upto + 3 * scores.rank_error(200)
    above = {r.threshold: r.share_above for r in scores.share_above(merged, [-1e9, 0.0, 1e9]).collect()}
    assert above[-1e9] == 1 and above[1e9] == 0 and abs(above[0.0] - (skewed > 0).mean()) < 3 * scores.rank_error(200)
    # a merged summary of batches is a start for exact values as well
    assert scores.percentiles(rows, "s", [0.9], summary=merged, size=200, small=10) == pytest.approx([np.percentile(skewed, 90)], rel=1e-12)
    assert scores.estimate(parts, [0.5]).columns == ["batch", "share", "estimate"]


def test_awkward_scores(spark):
    none = frame(spark, [None, float("nan")])
    assert scores.percentiles(none, "s", SHARES) == [] and scores.percentiles(none.limit(0), "s", [0.5]) == []
    assert scores.merge(scores.summarise(none, "s")).first().n == 0 and scores.estimate(scores.summarise(none, "s"), [0.5]).count() == 0
    assert scores.summarise(none, "s", ["batch"]).count() == 0
    assert scores.percentiles(frame(spark, [2.5]), "s", SHARES) == [2.5] * len(SHARES)
    assert scores.percentiles(frame(spark, [1, 2] * 500), "s", [0.0, 0.5, 1.0], small=3) == [1.0, 1.5, 2.0]
    wide = frame(spark, [float("-inf"), 1, 2, float("inf")])
    assert scores.percentiles(wide.where(F.abs("s") < 10), "s", [0.5]) == [1.5]
