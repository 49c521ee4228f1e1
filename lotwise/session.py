"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE decides broadcasts from measured sizes and splits skewed join partitions.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the operators count on."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may do without the setting: there one machine runs
    everything, so a fresh temporary folder is as good.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    folder = folder or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="lotwise-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/lotwise-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each write meanwhile are removed when it is done.

    A written table is read instead of them. Otherwise they stay until the driver happens to
    collect garbage, and those of all steps of a long job lie on disk at once.
    """
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, survives lost executors, and
    gives the optimizer true sizes and column pruning on the way back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_dropped(spark):
        df.write.parquet(path, compression="zstd")
    frame = spark.read.schema(df.schema).parquet(path)
    frame._written_path = path
    return frame


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame | None) -> None:
    """Remove tables made by ``written`` that nothing will read again."""
    for frame in frames:
        path = getattr(frame, "_written_path", None)
        if path is not None:
            _delete(frame.sparkSession, path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written, and the tables that it was made of (``_made_of``) removed: for results of their only reader."""
    table = written(df, name)
    discard(*getattr(df, "_made_of", ()))
    return table


def release(spark: SparkSession) -> None:
    """Remove everything this application wrote to the shared folder.

    For when results are consumed: DataFrames that read these tables fail afterwards.
    """
    _delete(spark, shared_folder(spark))
