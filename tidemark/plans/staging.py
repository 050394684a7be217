"""Cutting lineage through a written table.

A frame that several later steps read (signals, account states) is written once to the shared
folder the cluster names in ``spark.checkpoint.dir`` and read back, so a lost executor costs a
re-read, not a recomputation of the whole chain.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str | None:
    """The cluster's checkpoint folder; in local mode only, a fresh temporary one if none is set."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder is None and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_SETTING, folder) if spark.conf.isModifiable(_SETTING) else spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, kind: str = "work") -> str:
    """A path of its own in the shared folder, for tables, stream inputs and stream checkpoints."""
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError(f"set {_SETTING} to a folder that all executors share")
    return f"{folder}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the written table."""
    path = fresh_folder(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
