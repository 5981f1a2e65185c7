"""Cutting lineages in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder, others raise."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='simplark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder, so that lost executors never rerun what made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` materialised, and marked for broadcast if it has at most ``most`` rows; else joins shuffle."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= most else df
