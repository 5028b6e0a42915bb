"""Interval joins against all pairs."""

import datetime
import random

import pytest

from awardsift.operators.intervals import containing, overlapping

FAR = 9223372036854775807


def ranges_of(draw, n):
    out = []
    for k in range(n):
        low = draw.choice([draw.randrange(-50, 50), draw.randrange(-(2**40), 2**40), -FAR - 1, FAR - 5])
        length = draw.choice([0, 1, draw.randrange(10), draw.randrange(1 << 20), 1 << 41])
        out.append((k, low, min(FAR, low + length)))
    return [*out, (900, None, 5), (901, 5, None), (902, 7, 3), (903, -FAR - 1, FAR), (904, 4, 4), (904, 4, 4)]


def test_points(spark):
    draw = random.Random(1)
    ranges = ranges_of(draw, 60)
    points = [(k, draw.choice([None, draw.randrange(-60, 60), draw.randrange(-(2**41), 2**41), FAR, -FAR - 1, 4])) for k in range(120)]
    left, right = spark.createDataFrame(points, "p long, at long"), spark.createDataFrame(ranges, "r long, low long, high long")
    for open_low in (False, True):
        got = sorted((x.p, x.r) for x in containing(left, "at", right, "low", "high", open_low).collect())
        assert got == sorted((p, r) for p, at in points for r, low, high in ranges
                             if None not in (at, low, high) and low <= at <= high and not (open_low and at == low)) and len(got) > 100
    assert containing(left, "at", right.limit(0), "low", "high").count() == 0
    with pytest.raises(ValueError, match="both sides"):
        containing(left, "at", right.withColumnRenamed("r", "p"), "low", "high")
    with pytest.raises(ValueError, match="neither a date"):
        containing(left.selectExpr("p", "CAST(at AS DOUBLE) AS at"), "at", right, "low", "high")


def test_overlaps(spark):
    draw = random.Random(2)
    a, b = ranges_of(draw, 50), ranges_of(draw, 70)
    left, right = spark.createDataFrame(a, "a long, a1 long, a2 long"), spark.createDataFrame(b, "b long, b1 long, b2 long")
    found = overlapping(left, "a1", "a2", right, "b1", "b2")
    expected = sorted((x, y) for x, a1, a2 in a for y, b1, b2 in b if None not in (a1, a2, b1, b2) and a1 <= a2 and b1 <= b2 and a1 <= b2 and b1 <= a2)
    assert sorted((r.a, r.b) for r in found.collect()) == expected and len(expected) > 300
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dates(spark):
    day = datetime.date(2024, 1, 1)
    left = spark.createDataFrame([(k, day + datetime.timedelta(days=k)) for k in range(10)], "p long, at date")
    right = spark.createDataFrame([("x", day, day + datetime.timedelta(days=3)), ("y", day + datetime.timedelta(days=2), day + datetime.timedelta(days=40))], "r string, low date, high date")
    assert sorted((x.r, x.p) for x in containing(left, "at", right, "low", "high").collect()) == [("x", k) for k in range(4)] + [("y", k) for k in range(2, 10)]


def test_totals_without_pairs(spark, monkeypatch):
    """Totals over bins and groups of a few rows each are those of the listed pairs, and no pair is in the plan."""
    from pyspark.sql import functions as F

    from awardsift.operators import intervals

    draw = random.Random(3)
    a, b = [*ranges_of(draw, 90), (None, 3, 9), (7, 2, 2)], ranges_of(draw, 80)
    left = spark.createDataFrame([(*row, draw.choice([None, k, -FAR])) for k, row in enumerate(a)], "a long, a1 long, a2 long, av long")
    right = spark.createDataFrame([(*row, draw.choice([None, k])) for k, row in enumerate(b)], "b long, b1 long, b2 long, bv int")
    for places, group in ((20_000, 200_000), (5, 7)):
        monkeypatch.setattr(intervals, "PLACES", places)
        monkeypatch.setattr(intervals, "GROUP", group)
        for per, x in (("a", "bv"), ("b", "a")):
            asked = {"per": [per], "totals": {"n": ("count", "b" if per == "a" else "a1"), "least": ("min", x), "most": ("max", x), "s": ("sum", x)}}
            for join, args in ((containing, (left, "a1", right, "b1", "b2")), (containing, (right, "b1", left, "a1", "a2", True)), (overlapping, (left, "a1", "a2", right, "b1", "b2"))):
                listed = join(*args).groupBy(per).agg(F.count("b" if per == "a" else "a1").alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.sum(x).alias("s"))
                found = join(*args, **asked)
                assert found.columns == listed.columns and found.dtypes == listed.dtypes
                assert sorted(map(str, found.collect())) == sorted(map(str, listed.collect()))
    with pytest.raises(ValueError, match="one side"):
        containing(left, "a1", right, "b1", "b2", per=["a", "b"], totals={"n": ("count", "bv")})


def test_many_pairs(spark):
    """Every point in every range: 400 million pairs, which nobody lists."""
    points, ranges = spark.range(20_000).selectExpr("id AS p", "id AS at"), spark.range(20_000).selectExpr("id AS r", "-id AS low", "30000 + id AS high")
    found = containing(points, "at", ranges, "low", "high", per=["r"], totals={"n": ("count", "p"), "s": ("sum", "p")})
    assert found.where("n = 20000 AND s = 199990000").count() == 20_000
