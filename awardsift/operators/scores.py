"""Score summaries that merge: a quantile sketch with a stated rank error, and exact percentiles refined from it.

A summary is one row: ``n``, ``low``, ``high`` and a KLL sketch of some tens of kilobytes, whatever the number of scores. Tasks combine
theirs before the shuffle, and summaries of batches, days or departments are kept as rows of a table and merged later.
Null and NaN are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import SMALL

# Size parameter of the sketch: some 0.07 % of rank error, under 40 KB.
SIZE = 4096
SUMMARY = "n bigint, low double, high double, sketch binary"


def rank_error(size: int = SIZE) -> float:
    """How far the true rank share of an estimate may lie from the wanted one, with 99 % confidence."""
    return 2.296 / size**0.9723


def _values(df: DataFrame, column: str, *more: str) -> DataFrame:
    x = F.col(column).cast("double")
    return df.select(*more, x.alias("x")).where("x is not null and not isnan(x)")


def summarise(df: DataFrame, column: str, by: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """One summary, or one for each combination of ``by``. No row for a group without scores; one with ``n`` 0 without ``by``."""
    by = by or []
    return _values(df, column, *by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.kll_sketch_agg_double("x", size).alias("sketch"))


def merge(summaries: DataFrame, by: list[str] | None = None, size: int = SIZE) -> DataFrame:
    """Summaries of parts put together; the rank error stays that of one sketch."""
    return summaries.where("n > 0").groupBy(*(by or [])).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.kll_merge_agg_double("sketch", size).alias("sketch"))


def estimate(summary: DataFrame, shares: list[float]) -> DataFrame:
    """``share`` and ``estimate`` for each summary with scores, next to its other columns: no pass over the scores."""
    others = [c for c in summary.columns if c not in ("n", "low", "high", "sketch")]
    found = [F.struct(F.lit(float(s)).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))).alias("estimate")) for s in shares]
    return summary.where("n > 0").select(*others, F.inline(F.array(*found)))


def share_above(summary: DataFrame, thresholds: list[float]) -> DataFrame:
    """``threshold`` and the estimated share of scores above it, exactly 0 and 1 outside the range of the scores."""
    def found(t: float) -> Column:
        inside = 1 - F.kll_sketch_get_rank_double("sketch", F.lit(t))
        above = F.when(F.col("high") <= t, 0.0).when(F.col("low") > t, 1.0).otherwise(inside)
        return F.struct(F.lit(t).alias("threshold"), above.alias("share_above"))

    return summary.where("n > 0").select(F.inline(F.array(*[found(float(t)) for t in thresholds])))


class _Rank:
    """A wanted rank: the open interval of values it lies in, its 0-based place there, and the interval's rows and sketch."""

    def __init__(self, k: int, rows: int, sketch: bytes | None):
        self.low = self.high = self.value = None
        self.k, self.rows, self.sketch = k, rows, sketch

    def inside(self, x: Column) -> Column:
        low = F.lit(True) if self.low is None else x > F.lit(self.low)
        return low if self.high is None else low & (x < F.lit(self.high))

    def counts(self, x: Column, size: int) -> Column:
        """What one pass finds out: rows below, on, between, on and above two estimates around the rank, and a sketch of those between."""
        inside = self.inside(x)
        if self.sketch is None:
            return F.struct(F.kll_sketch_agg_double(F.when(inside, x), size).alias("sketch"))
        slack = min(2 * rank_error(size), 0.1)  # coarse sketches must narrow too
        ends = [min(1.0, max(0.0, self.k / self.rows - slack)), min(1.0, (self.k + 1) / self.rows + slack)]
        a, b = (F.kll_sketch_get_quantile_double(F.lit(self.sketch), F.lit(end)) for end in ends)
        between = inside & (x > a) & (x < b)
        return F.struct(
            a.alias("a"), b.alias("b"), F.count_if(inside & (x < a)).alias("below"), F.count_if(inside & (x == a)).alias("at_a"),
            F.count_if(between).alias("between"), F.count_if(inside & (x == b) & (x > a)).alias("at_b"),
            F.kll_sketch_agg_double(F.when(between, x), size).alias("sketch"))

    def narrow(self, found) -> None:
        if self.sketch is None:
            self.sketch = bytes(found["sketch"])
            return
        a, b = found["a"], found["b"]
        above = self.rows - found["below"] - found["at_a"] - found["between"] - found["at_b"]
        # an estimate off by more than its error costs one more pass, never the result
        zones = [(found["below"], None, self.low, a), (found["at_a"], a, None, None), (found["between"], None, a, b),
                 (found["at_b"], b, None, None), (above, None, b, self.high)]
        for at, (rows, value, low, high) in enumerate(zones):
            if self.k < rows:
                self.value, self.low, self.high, self.rows = value, low, high, rows
                self.sketch = bytes(found["sketch"]) if at == 2 else None
                return
            self.k -= rows
        raise ValueError("rank beyond the values")


def neighbours(
    df: DataFrame, column: str, shares: list[float], summary: DataFrame | None = None, size: int = SIZE, small: int = SMALL,
) -> list[tuple[float, float, float]]:
    """For each share the two exact order statistics around its place, and the weight of the second; empty without scores.

    One pass makes the summary, unless it is given, and one fetches the few values around all places; passes in between
    narrow the places down where they still hold more than ``small`` rows, by a factor of some 300 each, for all shares at once.
    Give a stored table: the scores must not change between the passes.
    """
    values, x = _values(df, column), F.col("x")
    whole = (summarise(df, column, size=size) if summary is None else summary).select("n", "sketch").first()
    if whole is None or not whole["n"]:
        return []
    n, sketch = whole["n"], bytes(whole["sketch"])
    places = [(n - 1) * share for share in shares]
    at = [min(math.floor(place), n - 1) for place in places]
    ranks = {k: _Rank(k, n, sketch) for k in {*at, *(min(k + 1, n - 1) for k in at)}}
    while any(r.value is None and r.rows > small for r in ranks.values()):
        wide = [r for r in ranks.values() if r.value is None and r.rows > small]
        found = values.agg(*[r.counts(x, size).alias(f"r{i}") for i, r in enumerate(wide)]).first()
        for i, rank in enumerate(wide):
            rank.narrow(found[f"r{i}"])
    open_ranks = [r for r in ranks.values() if r.value is None]
    if open_ranks:
        wanted = F.lit(False)
        for rank in open_ranks:
            wanted = wanted | rank.inside(x)
        few = values.where(wanted).groupBy("x").count().orderBy("x").collect()  # at most ``small`` rows for each rank
        for rank in open_ranks:
            left = rank.k
            for row in few:
                if (rank.low is None or row["x"] > rank.low) and (rank.high is None or row["x"] < rank.high):
                    if left < row["count"]:
                        rank.value = row["x"]
                        break
                    left -= row["count"]
    return [(ranks[k].value, ranks[min(k + 1, n - 1)].value, place - k) for k, place in zip(at, places)]


def between(low: float, high: float, weight: float) -> float:
    return low if weight == 0 else low + (high - low) * weight


def percentiles(df: DataFrame, column: str, shares: list[float], summary: DataFrame | None = None, size: int = SIZE, small: int = SMALL) -> list[float]:
    """Exact percentiles with linear interpolation, all in the same passes (see ``neighbours``); empty without scores."""
    return [between(*found) for found in neighbours(df, column, shares, summary, size, small)]
