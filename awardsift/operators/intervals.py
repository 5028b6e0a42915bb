"""Joins with ranges that may overlap and be of any number.

A range is filed under bins of its own size: the width is the power of two above its length, so it meets two bins at
most, however long it is (five of the widest). A point looks in one bin of each width that occurs among the ranges, 64 at most. The join is on
(width, bin), an equality that Spark can shuffle, broadcast and split where a bin is hot; the ends are tested afterwards.
Nothing is compared with everything, and no range is spread over many bins.

Pairs may be as many as points times ranges. Where only totals of them are asked for, ``totals`` gives them without any pair: the axis is
cut into bins at quantiles; bins that a range covers from end to end count by totals of bins, and the two bins it ends in are
worked out with a tree over the bin's own places, each bin in tasks of at most ``GROUP`` rows that ask.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, store

#: Bits of the widest bins; a longer range has this width and more bins would not help it.
WIDEST = 62


def _axis(df: DataFrame, name: str) -> Column:
    """A number on the axis of a column: days, microseconds, or a whole number itself."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name)
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    raise ValueError(f"{name} is {kind.simpleString()}, neither a date, a time nor a whole number")


def containing(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, open_low: bool = False,
               per: list[str] | None = None, totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of a point and a range that holds it: all columns of both. Both ends belong to the range unless ``open_low``.

    Points and ends that are null, and ranges that end before they begin, have no pairs. The sides' column names must differ.

    With ``totals`` the pairs are not listed, but summed up by ``per``, columns of one side: the new name of a total with its kind (``count``,
    ``sum``, ``min``, ``max``) and a column of whole numbers of the other side. Keys without pairs are left out, nulls count as in SQL.
    """
    clash = set(points.columns) & set(ranges.columns)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    if totals is not None:
        return _totals(points, at, ranges, low, high, open_low, per or [], totals)
    filed = ranges.withColumns({"_low": _axis(ranges, low), "_high": _axis(ranges, high)}).where("_low <= _high")
    # the length of two far ends may exceed a long: it wraps to a negative number, which means the widest bins
    length = F.call_function("try_subtract", F.col("_high"), F.col("_low"))
    width = F.when(length.isNull(), F.lit(WIDEST)).when(length == 0, F.lit(0)).otherwise(F.least(F.length(F.bin(length)), F.lit(WIDEST)))
    filed = filed.withColumn("_width", width.cast("int"))
    filed = filed.withColumn("_bin", F.expr("explode(sequence(shiftright(_low, _width), shiftright(_high, _width)))"))
    widths = sorted(r[0] for r in filed.select("_width").distinct().collect())  # 63 at most
    place = points.withColumn("_at", _axis(points, at)).where("_at IS NOT NULL")
    place = place.withColumn("_width", F.explode(F.array(*map(F.lit, widths)) if widths else F.array().cast("array<int>")))
    place = place.withColumn("_bin", F.expr("shiftright(_at, _width)"))
    inside = (F.col("_low") < F.col("_at") if open_low else F.col("_low") <= F.col("_at")) & (F.col("_at") <= F.col("_high"))
    return place.join(filed, ["_width", "_bin"]).where(inside).select(*[points[c] for c in points.columns], *[ranges[c] for c in ranges.columns])


#: Places of a bin, bins at most, and rows that ask in one group. A bin's places grow beyond the first only where all bins are in use.
PLACES, BINS, GROUP = 20_000, 512, 200_000
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_JOIN = {"sum": (np.add, 0), "min": (np.minimum, _MOST), "max": (np.maximum, _LEAST)}


def _paths(start: np.ndarray, stop: np.ndarray, size: int):
    """The nodes of a tree of ``size`` leaves that make up the slices start:stop: (which slices, their nodes), a level's left or right ends at a time."""
    left, right = start + size, np.maximum(stop, start) + size
    while (left < right).any():
        odd = np.flatnonzero((left < right) & (left & 1 == 1))
        yield odd, left[odd]
        left[odd] += 1
        odd = np.flatnonzero((left < right) & (right & 1 == 1))
        right[odd] -= 1
        yield odd, right[odd]
        left >>= 1
        right >>= 1


def _leaves(n: int) -> int:
    return 1 << max(n - 1, 0).bit_length()


def gathered(values: np.ndarray, kind: str, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The total of ``values[start:stop]`` for many slices."""
    (join, none), size = _JOIN[kind], _leaves(len(values))
    tree = np.full(2 * size, none, np.int64)
    tree[size:size + len(values)] = values
    level = size
    while level > 1:
        tree[level // 2:level] = join(tree[level:2 * level:2], tree[level + 1:2 * level:2])
        level //= 2
    out = np.full(len(start), none, np.int64)
    for which, nodes in _paths(start, stop, size):
        out[which] = join(out[which], tree[nodes])
    return out


def scattered(values: np.ndarray, kind: str, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the total of the values whose slice start:stop holds it."""
    (join, none), size = _JOIN[kind], _leaves(n)
    tree = np.full(2 * size, none, np.int64)
    for which, nodes in _paths(start, stop, size):
        join.at(tree, nodes, values[which])
    level = 1
    while level < size:
        tree[2 * level:4 * level] = join(tree[2 * level:4 * level], np.repeat(tree[level:2 * level], 2))
        level *= 2
    return tree[size:size + n]


class _Fields:
    """The long columns that totals are made of; each combines by sum, min or max. ``_f0`` counts the pairs."""

    def __init__(self, data: DataFrame, totals: dict[str, tuple[str, str]]):
        self.kinds, self.columns, self.out = ["sum"], [F.lit(1).cast("long")], []
        for name, (kind, column) in totals.items():
            if kind not in ("count", "sum", "min", "max") or not isinstance(data.schema[column].dataType, T.IntegralType):
                raise ValueError(f"no {kind} of {column}: counts, sums, least and largest of whole numbers only")
            x = F.col(column).cast("long")
            filled = self._add("sum", x.isNotNull().cast("long"))
            if kind == "count":
                self.out.append(filled.alias(name))
            elif kind == "sum":  # in halves, so that only the sum itself can be too large for a long
                high, low = self._add("sum", F.coalesce(F.shiftright(x, 32), F.lit(0))), self._add("sum", F.coalesce(x.bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0)))
                whole = high.cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + low.cast("decimal(20,0)")
                self.out.append(F.when(filled > 0, whole.cast("long")).alias(name))
            else:
                best = self._add(kind, F.coalesce(x, F.lit(_JOIN[kind][1])))
                self.out.append(F.when(filled > 0, best.cast(data.schema[column].dataType)).alias(name))
        self.names = [f"_f{k}" for k in range(len(self.kinds))]
        self.columns = [c.cast("long").alias(n) for n, c in zip(self.names, self.columns)]
        self.merged = [getattr(F, kind)(n).alias(n) for n, kind in zip(self.names, self.kinds)]

    def _add(self, kind: str, column: Column) -> Column:
        self.kinds.append(kind)
        self.columns.append(column)
        return F.col(f"_f{len(self.kinds) - 1}")


def _bounds(*places: DataFrame) -> np.ndarray:
    """Where bins begin: quantiles of the distinct places, at most ``BINS``. No result depends on them."""
    every = places[0]
    for more in places[1:]:
        every = every.union(more)
    shares = [k / BINS for k in range(1, BINS)]
    n, cuts = every.toDF("x").distinct().agg(F.count("x"), F.percentile_approx("x", shares, 10_000)).first()
    bins = min(BINS, max(1, n // PLACES))
    return np.unique(np.array([cuts[k * BINS // bins - 1] for k in range(1, bins)], np.int64))


def _totals(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, open_low: bool, per: list[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """``containing`` summed up by ``per``."""
    by_range = set(per) <= set(ranges.columns)
    if not per or not (by_range or set(per) <= set(points.columns)):
        raise ValueError("totals need the columns of one side that they are made for")
    spark = points.sparkSession
    ship_package(spark)
    fields = _Fields(points if by_range else ranges, totals)
    names = [f"_k{k}" for k in range(len(per))]
    keys = [F.col(c).alias(n) for n, c in zip(names, per)]
    place = points.select(_axis(points, at).alias("_at"), *(fields.columns if by_range else keys)).where("_at IS NOT NULL")
    filed = ranges.select(_axis(ranges, low).alias("_low"), _axis(ranges, high).alias("_high"), *(keys if by_range else fields.columns))
    filed = filed.where("_low < _high").withColumn("_low", F.col("_low") + 1) if open_low else filed.where("_low <= _high")
    place, filed = store(place), store(filed)
    bounds = _bounds(place.select("_at"), filed.select("_low"), filed.select("_high"))

    @F.arrow_udf("int")
    def bin_of(x: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, x.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    place = place.withColumn("_bin", bin_of("_at"))
    filed = filed.withColumns({"_first": bin_of("_low"), "_last": bin_of("_high")})
    wide = filed.where("_last - _first >= 2")
    ends = filed.withColumn("_bin", F.explode(F.array_distinct(F.array("_first", "_last"))))
    if by_range:
        data = place.groupBy("_bin", "_at").agg(*fields.merged)
        asked = ends.select("_bin", "_low", "_high", *names)
        whole = place.groupBy("_bin").agg(*fields.merged)  # a row a bin
        spans = whole.join(F.broadcast(spark.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_first"))), F.expr("_bin > _first"))
        spans = F.broadcast(spans.withColumn("_last", F.explode(F.sequence(F.col("_bin") + 1, F.lit(max(len(bounds), 1))))).where("_last > _bin")
                            .groupBy("_first", "_last").agg(*fields.merged))  # at most BINS * BINS / 2 rows
        covered = wide.select("_first", "_last", *names).join(spans, ["_first", "_last"])
    else:
        cut = [F.when(F.col("_bin") == F.col("_first"), F.col("_low")).otherwise(_LEAST).alias("_low"), F.when(F.col("_bin") == F.col("_last"), F.col("_high")).otherwise(_MOST).alias("_high")]
        data = ends.select("_bin", *cut, *fields.names).groupBy("_bin", "_low", "_high").agg(*fields.merged)
        asked = place.select("_bin", "_at", *names)
        spans = wide.groupBy("_first", "_last").agg(*fields.merged)  # at most BINS * BINS / 2 rows
        whole = spans.withColumn("_bin", F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1))).groupBy("_bin").agg(*fields.merged)
        covered = place.select("_bin", *names).join(F.broadcast(whole), "_bin")
    kinds = list(zip(fields.names, fields.kinds))

    def worked_out(data: pa.Table, asked: pa.Table) -> pa.Table:
        around = data if by_range else asked
        spots, place_of = np.unique(around["_at"].to_numpy(), return_inverse=True)
        slices = asked if by_range else data
        start, stop = np.searchsorted(spots, slices["_low"].to_numpy()), np.searchsorted(spots, slices["_high"].to_numpy(), side="right")
        found = {}
        for name, kind in kinds:
            values = data[name].to_numpy()
            if by_range:
                own = np.empty(len(spots), np.int64)
                own[place_of] = values
                found[name] = gathered(own, kind, start, stop)
            else:
                found[name] = scattered(values, kind, start, stop, len(spots))[place_of]
        out = asked.select(names)
        for name, _ in kinds:
            out = out.append_column(name, pa.array(found[name], pa.int64()))
        return out.filter(pa.array(found["_f0"] > 0))

    shares = asked.groupBy("_bin").agg(F.ceil(F.count(F.lit(1)) / F.lit(GROUP)).cast("int").alias("_shares"))
    shares = F.broadcast(store(shares))  # a row a bin
    asked = asked.withColumn("_row", F.monotonically_increasing_id()).join(shares, "_bin").withColumn("_share", F.pmod("_row", "_shares").cast("int")).drop("_row", "_shares")
    data = data.join(shares, "_bin").withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1))).drop("_shares")
    kind = {f.name: f.dataType.simpleString() for f in asked.schema}
    parts = data.groupBy("_bin", "_share").cogroup(asked.groupBy("_bin", "_share")).applyInArrow(
        worked_out, ", ".join([*(f"{n} {kind[n]}" for n in names), *(f"{n} long" for n in fields.names)]))
    every = parts.unionByName(covered.select(*names, *fields.names)).groupBy(*names).agg(*fields.merged)
    return every.select(*[F.col(n).alias(c) for n, c in zip(names, per)], *fields.out)


def overlapping(left: DataFrame, left_low: str, left_high: str, right: DataFrame, right_low: str, right_high: str,
                per: list[str] | None = None, totals: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of ranges that share a point: all columns of both.

    Either the left one begins within the right one, or the right one begins within the left one, later than it; each pair once.
    ``per`` and ``totals`` as in ``containing``.
    """
    left = left.where(F.col(left_low) <= F.col(left_high))
    right = right.where(F.col(right_low) <= F.col(right_high))
    begins = containing(left, left_low, right, right_low, right_high, per=per, totals=totals)
    later = containing(right, right_low, left, left_low, left_high, open_low=True, per=per, totals=totals)
    if totals is None:
        return begins.unionByName(later)
    again = [getattr(F, "sum" if kind == "count" else kind)(name).alias(name) for name, (kind, _) in totals.items()]
    return begins.unionByName(later).groupBy(*per).agg(*again)
