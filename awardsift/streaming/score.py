"""Structured Streaming around ``AwardModel.score``.

Scoring keeps no state: a map over the rows and joins with the model's own tables. Every micro-batch is
written to its own folder, so a batch that is repeated after a failure replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.schema_ops import review_projection
from ..plans.similarity import AwardModel


def score_stream(
    model: AwardModel, awards: DataFrame, path: str, checkpoint_path: str, threshold: float | None = None, once: bool = True,
) -> StreamingQuery:
    """Score a stream of awards; full results go to ``<path>/scored``, rows for review to ``<path>/review``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/scored/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{path}/scored/batch={number}")
        review_projection(stored).write.mode("overwrite").parquet(f"{path}/review/batch={number}")

    writer = model.score(awards, threshold).writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()
