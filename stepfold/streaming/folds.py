"""Structured Streaming: the state fold and the work queue kept from micro-batches, and windowed counts.

A correction may arrive at any time, so the folds keep the latest row of a key by its order columns instead of
dropping late rows by a watermark. State lies in buckets by key hash, each in one of two places: a micro-batch writes
the buckets that it touches to their other place, which holds what is two versions old, and then a manifest of one row a
bucket. Readers follow the manifest, so what a batch writes is in proportion to what it touches, nothing older piles up,
and a batch that fails half way, or runs twice, is not seen.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfold.operators.view import latest_versions, request_rechecks
from stepfold.session import shared_folder

BUCKETS = 64
MANIFEST = "batch long, bucket int, place int, written long, slot int"


def file_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder whose names match, as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _overwrite(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that `df` has rows of, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _manifest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """(batch, bucket, place, written) of the newest finished batch, or of the newest before a batch: one row a bucket, at most."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
        rows = rows if before is None else rows.where(F.col("batch") < before)
        newest = rows.agg(F.max("batch")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    if newest is None:
        return spark.createDataFrame([], MANIFEST).drop("slot")
    return rows.where(F.col("batch") == newest).drop("slot")


def state(spark: SparkSession, folder: str, schema: T.StructType, manifest: DataFrame | None = None) -> DataFrame:
    """The rows that the newest manifest (or the given one) points to. A manifest has one row a bucket, so it is broadcast."""
    held = F.broadcast((_manifest(spark, folder) if manifest is None else manifest).select("bucket", "place", "written"))
    try:
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("written", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("place", T.IntegerType())])).parquet(f"{folder}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    return rows.join(held, ["bucket", "place", "written"]).select(*schema.names)


def advance(batch: DataFrame, number: int, folder: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], schema: T.StructType, buckets: int = BUCKETS) -> None:
    """Takes a micro-batch into the state: merge(rows of the touched buckets, batch) gives their new rows."""
    spark = batch.sparkSession
    old = _manifest(spark, folder, number)
    dealt = batch.withColumn("bucket", _bucket(keys, buckets))
    touched = dealt.select("bucket").distinct()  # one row a bucket, at most
    moved = touched.join(F.broadcast(old.select("bucket", "place")), "bucket", "left").select("bucket", (1 - F.coalesce("place", F.lit(1))).alias("place"))
    moved = spark.createDataFrame([(number, r.bucket, r.place, number) for r in moved.collect()], "batch long, bucket int, place int, written long")
    before = state(spark, folder, schema, old.join(F.broadcast(moved.select("bucket")), "bucket", "left_semi"))
    merged = merge(before, batch).select(*schema.names).withColumn("bucket", _bucket(keys, buckets)).withColumn("written", F.lit(number).cast("long"))
    _overwrite(merged.join(F.broadcast(moved.select("bucket", "place")), "bucket"), f"{folder}/data", "bucket", "place")
    kept = old.join(F.broadcast(moved.select("bucket")), "bucket", "left_anti").withColumn("batch", F.lit(number).cast("long"))
    both = kept.unionByName(moved).withColumn("slot", F.lit(number % 2))
    _overwrite(both.coalesce(1), f"{folder}/manifest", "slot")


def _run(stream: DataFrame, folder: str, step, schema: T.StructType) -> DataFrame:
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return state(stream.sparkSession, folder, schema)


def fold(stream: DataFrame, keys: list[str], order: list[str], folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Reads all that is there and gives the latest row of each key by `order`."""
    folder = folder or f"{shared_folder(stream.sparkSession)}/fold-{uuid.uuid4().hex}"
    merge = lambda before, batch: latest_versions(before.unionByName(batch), keys, order)

    def step(batch: DataFrame, number: int) -> None:
        advance(batch, number, folder, keys, merge, stream.schema, buckets)

    return _run(stream, folder, step, stream.schema)


def recheck_queue(stream: DataFrame, keys: list[str], folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The queue of all requested keys with their generation: how many micro-batches asked for them."""
    folder = folder or f"{shared_folder(stream.sparkSession)}/queue-{uuid.uuid4().hex}"
    schema = stream.select(*keys, F.lit(0).cast("long").alias("gen")).schema

    def step(batch: DataFrame, number: int) -> None:
        advance(batch, number, folder, keys, lambda before, asked: request_rechecks(before, asked, keys), schema, buckets)

    return _run(stream, folder, step, schema)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts in event-time windows, for consumers that may drop what is later than `late`."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *by, "n", "total")
