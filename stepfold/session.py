"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "stepfold", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; a temporary one only on a local master that names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """`df`, joined by shuffle and sort, never broadcast: for tables whose size Spark underrates, as it takes all rows that
    come of an exploded one for one, also once they are kept. Holds through all but joins and unions."""
    return df.hint("merge")


def vocabulary(df: DataFrame, most: int = 100_000) -> DataFrame:
    """`df`, to be broadcast if it has at most `most` rows, which are counted first; a larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


ROWS_A_TASK = 250_000  #: that a task sorts at a time, about


def tasks_for(df: DataFrame, wide: int = 1) -> int:
    """Tasks that `df`, `wide` rows of work for each of its rows, is dealt to by `repartition`, so that what a task sorts does
    not grow with the table; Spark merges the partitions of its own shuffles into as many as there are cores. The rows are counted."""
    return max(-(-df.count() * wide // ROWS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
