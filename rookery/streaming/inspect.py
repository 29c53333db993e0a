"""Looking into the live state of a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def live_state(spark: SparkSession, checkpoint: str, name: str = "state", operator: int = 0) -> DataFrame:
    """Keys and values of a state variable (`state`, or `rows` for what waits) in a query's checkpoint."""
    return spark.read.format("statestore").option("operatorId", operator).option("stateVarName", name).load(checkpoint)
