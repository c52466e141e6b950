"""Checkpoints for operators that work in rounds, and the folder they share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder that spark.checkpoint.dir names. Where none is set, a folder of our own is made on a local master only."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="staveflow-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    _shared(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, prefix: str) -> str:
    """A folder name of its own in the shared folder; nothing is made there yet."""
    return f"{_shared(spark)}/{prefix}-{uuid.uuid4().hex}"
