"""The test tables by name, and the roles that the queries bind."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: entity, order and value of the event log
ENTITY, ORDER, VALUE = "user_id", ["ts", "event_id"], "value"
