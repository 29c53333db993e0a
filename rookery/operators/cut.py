"""Cutting lineage where a frame is read again and again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession) -> str:
    """A new folder in the session's shared checkpoint folder.

    spark.checkpoint.dir is used where it is set. Where it isn't, a local
    session (tests) uses a folder beside the warehouse; on a cluster that would
    be each machine's own, so it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "-checkpoints"
    return f"{base.rstrip('/')}/rookery-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again. A lost executor costs nothing that is written."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
