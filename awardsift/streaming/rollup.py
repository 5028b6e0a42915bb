"""The award roll-up as a stream: one value of state for each award.

Each micro-batch folds its rows into the state of their awards and gives the awards it has rows of; whatever the split into
batches and the order of arrival, the last row of an award is what ``rollup_awards`` gives for all rows. These rows are
written to a folder for each batch, which a repeated batch overwrites, and ``current_awards`` keeps the last of each award.

Without a watermark the state of an award is kept for good: a streaming aggregation, which combines the rows of a task before
they meet the state and needs no Python. With one, an award that no row has come for within ``idle`` of event
time is closed by a timer: its state goes, its last row stays. A row that comes later than the watermark allows is dropped by Spark
before the state sees it (``numRowsDroppedByWatermark`` of the query's progress counts them); a row in time for a closed
award opens it anew, and ``current_awards`` folds the openings together.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import ship_package

TEXTS = ("description", "vendor", "agency")
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _greater(a, b):
    """The larger of two values as SQL's max has it: nulls aside, NaN on top."""
    if a is None or b is None:
        return a if b is None else b
    return a if a != a or b <= a else b


def _rank(order) -> tuple:
    """Order values in the order of a struct: nulls first."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in order)


def merged(state: dict | None, row: dict, order: list[str]) -> dict:
    """The state of an award after one more row."""
    if state is None:
        state = {"value": None, "end_date": None, **{c: None for t in TEXTS for c in (t, *(f"{t}_{o}" for o in order))}}
    out = {**state, "value": _greater(state["value"], row["value"]), "end_date": _greater(state["end_date"], row["end_date"])}
    place = [row[o] for o in order]
    for t in TEXTS:
        if row[t] is not None and (state[t] is None or _rank(place) < _rank([state[f"{t}_{o}"] for o in order])):
            out[t] = row[t]
            out.update({f"{t}_{o}": v for o, v in zip(order, place)})
    return out


class AwardState(StatefulProcessor):
    """Value state of an award: its largest value, latest end date, and first texts with their place in the order."""

    def __init__(self, keys: list[str], order: list[str], state: T.StructType, idle_ms: int):
        self.keys, self.order, self.shape, self.idle_ms = keys, order, state, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.award = handle.getValueState("award", self.shape)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        kept = self.award.get()
        state = None if kept is None else dict(zip(self.shape.names, kept))
        opening = state.pop("opening") if state else uuid.uuid4().hex
        seen = state.pop("seen") if state else None
        for row in rows:
            row = row.asDict()
            state = merged(state, row, self.order)
            if self.idle_ms:
                seen = _greater(seen, row["_at"])
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(seen + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        after = tuple({**state, "opening": opening, "seen": seen}[c] for c in self.shape.names)
        if kept is not None and after == tuple(kept):
            return
        self.award.update(after)
        yield Row(**dict(zip(self.keys, key)), **{c: state[c] for c in self.shape.names[:-2]}, opening=opening)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.award.clear()
        return iter(())

    def close(self) -> None:
        pass


def _shapes(df: DataFrame, keys: list[str], order: list[str]) -> tuple[T.StructType, T.StructType]:
    kinds = {f.name: f.dataType for f in df.schema}
    names = ["value", "end_date", *[c for t in TEXTS for c in (t, *(f"{t}_{o}" for o in order))]]
    kind = {**{c: kinds[c] for c in ("value", "end_date", *TEXTS)}, **{f"{t}_{o}": kinds[o] for t in TEXTS for o in order}}
    folded = [T.StructField(c, kind[c]) for c in names]
    state = T.StructType([*folded, T.StructField("opening", T.StringType()), T.StructField("seen", T.LongType())])
    return state, T.StructType([*[T.StructField(k, kinds[k]) for k in keys], *folded, T.StructField("opening", T.StringType())])


def _folded(known: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The state of each award for good, as an aggregation: every award has one opening."""
    place = [F.col(o).alias(f"o{k}") for k, o in enumerate(order)]
    firsts = [F.min(F.when(F.col(t).isNotNull(), F.struct(*place, F.col(t).alias("text")))).alias(t) for t in TEXTS]
    state = known.groupBy(*keys).agg(F.max("value").alias("value"), F.max("end_date").alias("end_date"), *firsts)
    texts = [F.col(t)[c].alias(name) for t in TEXTS for c, name in (("text", t), *((f"o{k}", f"{t}_{o}") for k, o in enumerate(order)))]
    return state.select(*keys, "value", "end_date", *texts, F.lit("").alias("opening"))


def rollup_changes(awards: DataFrame, keys: list[str], order: list[str], watermark: tuple[str, str] | None = None, idle: datetime.timedelta | None = None) -> DataFrame:
    """The awards that each batch has rows of, with the places of their texts; a streaming frame for update mode.

    ``watermark`` is an event-time column and its delay; ``idle`` closes awards and needs it. Then awards that a batch
    leaves as they were are left out.
    """
    if (idle is None) != (watermark is None):
        raise ValueError("give both a watermark and the idle time after which awards are closed, or neither")
    spark = awards.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    known = awards.where(F.col("piid").isNotNull())
    if not watermark:
        return _folded(known, keys, order)
    ship_package(spark)
    known = known.withColumns({"_event": F.col(watermark[0]), "_at": F.unix_millis(F.col(watermark[0]))}).withWatermark("_event", watermark[1])
    # times are numbers in the state, whatever the time zones of the workers
    times = [f.name for f in awards.schema if isinstance(f.dataType, T.TimestampType) and f.name in ("end_date", *keys, *order)]
    plain = known.select(*keys, "value", "end_date", *TEXTS, *[c for c in order if c not in keys], "_event", "_at")
    plain = plain.withColumns({c: F.unix_micros(c) for c in times})
    state, out = _shapes(plain, keys, order)
    processor = AwardState(keys, order, state, int(idle.total_seconds() * 1000))
    changed = plain.groupBy(*keys).transformWithState(processor, out, "Update", "EventTime")
    back = [c for c in changed.columns if c in times or any(c == f"{t}_{o}" for t in TEXTS for o in times)]
    return changed.withColumns({c: F.timestamp_micros(c) for c in back})


def rollup_stream(awards: DataFrame, path: str, checkpoint_path: str, keys: list[str], order: list[str], watermark: tuple[str, str] | None = None,
                  idle: datetime.timedelta | None = None, once: bool = True) -> StreamingQuery:
    """Keep the roll-up of a stream of awards under ``path``."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    changes = rollup_changes(awards, keys, order, watermark, idle)
    writer = changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint_path).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current_awards(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """One row an award, as ``rollup_awards`` gives it: the last row of each opening, openings folded together."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch", "opening")]
    last = rows.groupBy(*keys, "opening").agg(F.max_by(F.struct(*rest), "batch").alias("row")).select(*keys, "row.*")

    def first(name: str):
        at = F.struct(*[f"{name}_{o}" for o in order])
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), at)).alias(name)

    return last.groupBy(*keys).agg(first("description"), F.max("value").alias("value"), F.max("end_date").alias("end_date"), first("vendor"), first("agency"))
