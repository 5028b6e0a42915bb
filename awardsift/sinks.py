"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import run_stamp
from .operators.aggregates import by_score, run_summary
from .operators.schema_ops import review_projection


def write_awards(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite") -> None:
    """Processed awards by award type and department.

    The rebalance hint sizes the files and splits a department that holds most of the rows.
    """
    out = df.hint("rebalance", "award_type", "department")
    _write(out, path, kind, mode, ["award_type", "department"])


def _write(df: DataFrame, path: str, kind: str, mode: str, partitions: list[str] = ()) -> None:
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", True).option("escape", '"')
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.save(path)


def stamp(df: DataFrame) -> str:
    """Run stamp of now, from the session's clock and time zone."""
    return df.sparkSession.range(1).select(run_stamp()).first()[0]


def write_predictions(df: DataFrame, path: str, run_ts: str | None = None, kind: str = "parquet") -> str:
    """All scored awards by falling score, in a folder named after the run. Returns the folder.

    The sort reads ``df`` twice: give it ``AwardModel.predict``'s result or another stored table.
    """
    run_ts = run_ts or stamp(df)
    folder = f"{path}/anomaly_predictions_{run_ts}"
    _write(by_score(df).withColumn("run_ts", F.lit(run_ts)), folder, kind, "errorifexists")
    return folder


def write_review(df: DataFrame, path: str, kind: str = "csv") -> str:
    """The awards for review, with the review columns, by falling score."""
    folder = f"{path}/anomaly_predictions"
    _write(by_score(review_projection(df), tie="piid"), folder, kind, "overwrite")
    return folder


def write_snapshot(df: DataFrame, path: str, name: str, run_ts: str | None = None) -> str:
    """Labeled records as JSON lines in a folder named after the run; ``latest_snapshot`` finds and ``read_labeled`` reads it."""
    folder = f"{path}/{name}_{run_ts or stamp(df)}.json"
    df.write.mode("errorifexists").json(folder)
    return folder


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").json(path)


def write_summary(outputs: DataFrame, path: str) -> None:
    run_summary(outputs).write.mode("overwrite").json(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
