"""Retries with back-off as keyed state with processing-time timers: a failed attempt waits, and after the last it is parked."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stepfold.session import shared_folder

# Seconds before the second and the third attempt, and the quiet seconds after a request that overtook one.
DELAYS = (2.0, 10.0)
QUIET = 1.0
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "key long, attempt int, outcome string, requests long"


def processor(work: Callable[[int, str, int], bool], delays: tuple[float, ...] = DELAYS, quiet: float = QUIET) -> StatefulProcessor:
    """The state machine of one key. Its class is made here, so that Spark's workers need no import of this package."""

    class Retries(StatefulProcessor):
        """One key's work: requests (key, payload) are attempted, `work(key, payload, attempt)` says whether that succeeded.

        A request while the key waits is taken into the waiting one (its payload wins) and moves the next attempt to the end
        of a quiet period, so a key that is being worked on is not attempted again and again. A parked key waits for the
        next request, which starts anew.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.waiting = handle.getValueState("waiting", "payload string, failed int, requests long, due long")

        def _attempt(self, key: int, payload: str, failed: int, requests: int, now: int) -> pd.DataFrame:
            ok = work(key, payload, failed + 1)
            if ok or failed >= len(delays):
                self.waiting.clear()
                outcome = "done" if ok else "parked"
            else:
                self._wait(payload, failed + 1, requests, now + int(delays[failed] * 1000))
                outcome = "retry"
            return pd.DataFrame({"key": [key], "attempt": [failed + 1], "outcome": [outcome], "requests": [requests]})

        def _wait(self, payload: str, failed: int, requests: int, due: int) -> None:
            self.waiting.update((payload, failed, requests, due))
            self.handle.registerTimer(due)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            every = pd.concat(list(rows))
            payload, n, now = every["payload"].max(), len(every), timerValues.getCurrentProcessingTimeInMs()
            if (was := self.waiting.get()) is not None:
                _, failed, requests, due = was
                self.handle.deleteTimer(due)  # the only one: an expired timer goes by itself
                self._wait(payload, failed, requests + n, max(due, now + int(quiet * 1000)))
            else:
                yield self._attempt(int(key[0]), payload, 0, n, now)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if (was := self.waiting.get()) is not None:
                payload, failed, requests, _ = was
                yield self._attempt(int(key[0]), payload, failed, requests, timerValues.getCurrentProcessingTimeInMs())

        def close(self) -> None:
            pass

    return Retries()


def outcomes(requests: DataFrame, work: Callable[[int, str, int], bool], delays: tuple[float, ...] = DELAYS, quiet: float = QUIET) -> DataFrame:
    """(key, attempt, outcome, requests) of each attempt of a stream of requests (key long, payload string): done, retry
    or parked; `requests` is how many were taken together. Rows without a key are left out. The session's state store
    must be RocksDB (`PROVIDER`)."""
    keyed = requests.where("key is not null").select(F.col("key").cast("long").alias("key"), F.coalesce("payload", F.lit("")).alias("payload"))
    return keyed.groupBy("key").transformWithStateInPandas(processor(work, delays, quiet), OUTCOME, outputMode="append", timeMode="processingTime")


def drained(requests: DataFrame, work: Callable[[int, str, int], bool], delays: tuple[float, ...] = DELAYS, quiet: float = QUIET, folder: str | None = None, stop_after: Callable[[DataFrame], bool] | None = None, patience: float = 300.0) -> DataFrame:
    """Runs the stream until no key waits (or `stop_after` says so of the outcomes so far) and gives all attempts with
    their batch. Started again on the same folder it goes on from its checkpoint, timers included; a batch that runs
    twice writes the same place twice."""
    spark = requests.sparkSession
    folder = folder or f"{shared_folder(spark)}/retries-{uuid.uuid4().hex}"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{folder}/attempts")

    try:
        query = outcomes(requests, work, delays, quiet).writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(processingTime="200 milliseconds").start()
        try:
            read = lambda: spark.read.schema(f"{OUTCOME}, batch long").parquet(f"{folder}/attempts")
            last = F.max_by("outcome", F.struct("batch", "attempt")).alias("o")
            finished = stop_after or (lambda rows: not rows.groupBy("key").agg(last).where("o = 'retry'").take(1))
            end = time.monotonic() + patience
            # batches go on for the timers, so a batch without rows is what tells that all requests are in
            while not ((query.lastProgress or {}).get("numInputRows", 1) == 0 and finished(read())):
                if query.exception() is not None or time.monotonic() > end:
                    raise RuntimeError(f"keys still wait: {query.exception()}")
                time.sleep(0.2)
        finally:
            query.stop()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return read()
