"""Session helpers: settings the jobs rely on, checkpoints and measured broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is hinted as a broadcast only after it was counted and found within both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", spread: int = 0) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("awardsift")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("awardsift.spread", str(spread))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Needed wherever a task runs Python code of the package and the package is not installed on the workers.
    The archive is a file of the driver that Spark itself hands to every executor.
    """
    context = spark.sparkContext
    if getattr(context, "_awardsift_shipped", False):
        return
    package = Path(__file__).resolve().parent
    if not package.is_dir():
        return  # imported from an archive, which the application has shipped already
    archive = Path(tempfile.mkdtemp(prefix="awardsift-package-")) / "awardsift.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._awardsift_shipped = True


def _checkpoint_folder(spark: SparkSession) -> str:
    """The application's folder inside the cluster's ``spark.checkpoint.dir``.

    A folder of our own is made only for a local master, where every task runs on this machine.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="awardsift-checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back without lineage, partition by partition.

    For small tables, and for tables whose partitions or row numbers must stay as they are.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the checkpoint folder and read it back without lineage.

    For wide tables that several jobs read: compressed, and each job reads only the columns it needs.
    """
    path = f"{_checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """The scan dealt over as many tasks as the session's ``awardsift.spread`` says; by default the scan itself.

    An option for callers whose few files cannot be split and whose work is heavy per row. It never depends on the
    data, and no result depends on it.
    """
    tasks = int(scan.sparkSession.conf.get("awardsift.spread", "0"))
    return scan.repartition(tasks) if tasks else scan


def measure(df: DataFrame, **more: Column) -> tuple:
    """Row count and an upper estimate of the bytes of a table, then ``more`` aggregates, in one pass."""
    width = F.lit(0)
    for name, kind in df.dtypes:
        width = width + (F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 16 if kind == "string" else F.lit(16))
    extra = [value.alias(name) for name, value in more.items()]
    return tuple(df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"), *extra).first())


def broadcast_if_small(df: DataFrame, size: tuple[int, int] | None = None) -> DataFrame:
    """Hint a broadcast when the measured size is in bounds; otherwise leave the join to AQE.

    Beyond the bound the join is a shuffle join, whose hot keys AQE splits over several tasks.
    """
    rows, volume = size if size is not None else measure(df)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and volume <= BROADCAST_BYTES else df
