"""Streams against what a batch over the same rows gives; restarts, reruns and what a batch writes."""

import os
import tempfile
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import functions as F

from stepfold.operators.view import latest_versions
from stepfold.streaming import folds, retries


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def written(folder):
    """Path and change time of each data file."""
    out = {}
    for d, _, names in os.walk(f"{folder}/data"):
        out |= {f"{d}/{n}": os.stat(f"{d}/{n}").st_mtime_ns for n in names if n.endswith(".parquet")}
    return out


def test_fold_writes_touched_buckets_only(spark):
    schema, base, state = "k long, at long, v string", tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{base}/*")
    rows, sizes = [], []
    batches = [[(k, 0, "a") for k in range(400)], [(7, 1, "b")], [(7, 3, "d"), (8, 1, "x")], [(7, 2, "late"), (None, 0, "n")]]
    for n, batch in enumerate(batches):
        put(spark, base, n, batch, schema)
        rows += batch
        before = written(state)
        got = folds.fold(stream(), ["k"], ["at"], state, buckets=16)
        want = latest_versions(spark.createDataFrame(rows, schema), ["k"], ["at"])
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        after = written(state)
        sizes.append(len([f for f in after if before.get(f) != after[f]]))
    assert sizes[0] == 16 and sizes[1] == 1 and sizes[2] <= 2 and sizes[3] <= 2
    assert len(written(state)) <= 2 * 16  # two places a bucket, whatever the number of batches


def test_failed_and_repeated_batches_are_not_seen(spark):
    schema, state = "k long, at long", tempfile.mkdtemp(prefix="spark-")
    kind = spark.createDataFrame([], schema).schema
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    newest = lambda before, b: latest_versions(before.unionByName(b), ["k"], ["at"])
    read = lambda: sorted(tuple(r) for r in folds.state(spark, state, kind).collect())
    folds.advance(batch((1, 0), (2, 0)), 0, state, ["k"], newest, kind, 4)

    def breaks(before, b):
        raise RuntimeError("lost")

    try:
        folds.advance(batch((1, 5)), 1, state, ["k"], breaks, kind, 4)
    except RuntimeError:
        pass
    assert read() == [(1, 0), (2, 0)]
    for _ in range(2):
        folds.advance(batch((1, 5)), 1, state, ["k"], newest, kind, 4)
        assert read() == [(1, 5), (2, 0)]
    folds.advance(batch((1, 6), (3, 0)), 2, state, ["k"], newest, kind, 4)
    for _ in range(2):  # an earlier batch that runs again after a restart starts from what was before it
        folds.advance(batch((1, 6), (3, 0)), 2, state, ["k"], newest, kind, 4)
    assert read() == [(1, 6), (2, 0), (3, 0)]
    folds.advance(batch().limit(0), 3, state, ["k"], newest, kind, 4)
    assert read() == [(1, 6), (2, 0), (3, 0)]


def test_queue_counts_batches(spark):
    schema, base, state = "k long", tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    for n, batch in enumerate([[(1,), (1,), (2,)], [(1,), (3,)]]):
        put(spark, base, n, batch, schema)
        got = folds.recheck_queue(spark.readStream.schema(schema).parquet(f"{base}/*"), ["k"], state)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2), (2, 1), (3, 1)]


def test_retries_go_on_after_a_restart(spark):
    """Two retries and a park; the stream is stopped after the first attempts and started again on its checkpoint."""
    schema, base, state = "key long, payload string", tempfile.mkdtemp(prefix="spark-"), tempfile.mkdtemp(prefix="spark-")
    put(spark, base, 0, [(0, "0"), (1, "1"), (2, "2"), (3, "9"), (3, "9"), (None, "0")], schema)
    stream = lambda: spark.readStream.schema(schema).parquet(f"{base}/*")
    work = lambda key, payload, attempt: attempt > int(payload)
    first = retries.drained(stream(), work, (12.0, 0.5), 0.2, state, stop_after=lambda rows: rows.count() >= 4)
    before = {(r.key, r.attempt) for r in first.collect()}
    assert before >= {(k, 1) for k in range(4)} and len(before) < 9  # the rest is up to the timers in the checkpoint
    rest = retries.drained(stream(), work, (12.0, 0.5), 0.2, state)
    got = sorted((r.key, r.attempt, r.outcome, r.requests) for r in rest.collect())
    assert got == [(0, 1, "done", 1), (1, 1, "retry", 1), (1, 2, "done", 1), (2, 1, "retry", 1), (2, 2, "retry", 1), (2, 3, "done", 1), (3, 1, "retry", 2), (3, 2, "retry", 2), (3, 3, "parked", 2)]
    # a parked key starts anew with the next request
    put(spark, base, 1, [(3, "0")], schema)
    again = retries.drained(stream(), work, (12.0, 0.5), 0.2, state, stop_after=lambda rows: rows.where(F.col("key") == 3).count() == 4)
    assert again.where("key = 3 and outcome = 'done' and attempt = 1").count() == 1


def test_an_attempt_asks_the_store_little():
    """Each call on state or timers goes to another process; one timer is live at a time."""

    class Store:
        def __init__(self):
            self.value, self.timers, self.calls = None, set(), 0

        def __getattr__(self, name):
            self.calls += 1
            todo = {"get": lambda: self.value, "exists": lambda: self.value is not None, "update": lambda v: setattr(self, "value", v), "clear": lambda: setattr(self, "value", None)}
            todo |= {"registerTimer": self.timers.add, "deleteTimer": self.timers.remove, "listTimers": lambda: iter(sorted(self.timers)), "getValueState": lambda *_: self}
            return todo[name]

    clock = lambda t: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: t)
    p, store = retries.processor(lambda key, payload, attempt: attempt > 2, (0.5, 1.0), 0.2), Store()
    p.init(store)
    request, said = pd.DataFrame({"payload": ["x"]}), []
    for step in (lambda: p.handleInputRows((1,), iter([request]), clock(0)), lambda: p.handleInputRows((1,), iter([request]), clock(400)), lambda: p.handleExpiredTimer((1,), clock(600), None), lambda: p.handleExpiredTimer((1,), clock(1600), None)):
        before, store.calls = set(store.timers), 0
        said += [tuple(r) for out in step() or [] for r in out.itertuples(index=False)]
        assert store.calls <= 4
        if len(said) > 1:  # Spark removes an expired timer
            store.timers -= before
    assert said == [(1, 1, "retry", 1), (1, 2, "retry", 2), (1, 3, "done", 2)] and not store.timers and store.value is None
