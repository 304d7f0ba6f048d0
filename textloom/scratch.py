"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder and everything runs in one process.
LOCAL_FOLDER = "file:///tmp/checkpoints"


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, else below the context's checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = LOCAL_FOLDER
    return f"{root.rstrip('/')}/textloom-core-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written and read back: one evaluation, whoever reads it and whatever is lost."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
