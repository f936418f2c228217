"""Queries that run a stream over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stepfold.plans.registry import query
from stepfold.plans.tables import ENTITY, table
from stepfold.session import shared_folder
from stepfold.streaming import folds, retries


@query("stream_state_fold", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def stream_state_fold(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = folds.file_stream(spark, sf_dir, "events.parquet", schema).select(ENTITY, "event_type", "ts", "event_id", "value")
    return folds.fold(stream, [ENTITY, "event_type"], ["ts", "event_id"]).select(ENTITY, "event_type", "event_id", "value")


@query("stream_recheck_queue", "SELECT DISTINCT user_id, 1::BIGINT AS gen FROM events WHERE event_type = 'error'")
def stream_recheck_queue(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    stream = folds.file_stream(spark, sf_dir, "events.parquet", schema).where(F.col("event_type") == "error").select(ENTITY)
    return folds.recheck_queue(stream, [ENTITY])


@query("stream_retries", """
WITH r AS (SELECT user_id AS key, user_id % 4 AS fails, count(*) AS requests FROM events WHERE event_type = 'error' GROUP BY user_id), a AS (SELECT unnest(range(1, 4)) AS attempt)
SELECT key, attempt::INTEGER AS attempt, CASE WHEN attempt > fails THEN 'done' WHEN attempt = 3 THEN 'parked' ELSE 'retry' END AS outcome, requests FROM r JOIN a ON attempt <= least(fails + 1, 3)""")
def stream_retries(spark, sf_dir):
    """Work that fails as often as its key says: tried again after two waits, then parked. All requests of a key come in
    one batch and are one piece of work."""
    schema = table(spark, sf_dir, "events").schema
    stream = folds.file_stream(spark, sf_dir, "events.parquet", schema).where(F.col("event_type") == "error")
    requests = stream.select(F.col(ENTITY).alias("key"), (F.col(ENTITY) % 4).cast("string").alias("payload"))
    return retries.drained(requests, lambda key, payload, attempt: attempt > int(payload), (0.5, 1.0), 0.2).drop("batch")


@query("stream_windowed_counts", """
SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_windowed_counts(spark, sf_dir):
    """Event-time windows of an hour, closed by a watermark that nothing here is later than, read when all is in."""
    schema = table(spark, sf_dir, "events").schema
    stream = folds.file_stream(spark, sf_dir, "events.parquet", schema)
    counts = folds.windowed_counts(stream, "ts", ["event_type"], "1 hour", "3650 days")
    folder = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/{number % 2}")
    run = counts.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    done = spark.read.parquet(f"{folder}/{run.lastProgress['batchId'] % 2}")
    return done.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
