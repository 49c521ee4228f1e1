"""Small things the operators share: tables, session settings, written tables."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.session import configure, discard, new_path, written

__all__ = ["table", "ready", "written", "discard", "new_path", "fold_of"]

# Rows in an Arrow batch. Texts are cut further by bytes (``vec.slices``), so this
# bounds what a Python worker holds when texts are long.
ARROW_ROWS = "512"


def ready(spark: SparkSession) -> SparkSession:
    """Session with the library's SQL options and small Arrow batches.

    Python workers look for this package where the driver found it, if it isn't
    installed for them.
    """
    configure(spark)
    workers = spark.sparkContext.environment
    here = str(Path(__file__).parents[2])
    paths = workers.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([*filter(None, paths), here])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id) -> F.Column:
    """Remainder that holds rows out: crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3
