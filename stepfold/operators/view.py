"""A materialized view kept by content digests: refresh, frozen rows, conflicts, work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def digest(*cols: str) -> Column:
    """sha1 of the values, nulls told apart from empty texts."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in cols]))


def outdated(inputs: DataFrame, stamps: DataFrame, keys: list[str], version: int) -> DataFrame:
    """Keys whose inputs have another digest, compiler version or row count than the stamp, or no stamp."""
    current = stamps.where(F.col("version") == version).select(*keys, "digest", "n_rows")
    return inputs.join(current, [*keys, "digest", "n_rows"], "left_anti")


def refresh_actions(stored: DataFrame, fresh: DataFrame, keys: list[str], distance: Column, tolerance: Column, measured: dict[str, Column] | None = None) -> DataFrame:
    """What a refresh does with each row: insert, update, delete, keep, or queue a conflict.

    Verified rows are never written: they are queued when `distance` (of stored_value and fresh_value) exceeds the
    tolerance or when the row vanished. Other rows follow the fresh side. `measured` columns are computed first and
    stay, so that `distance` may name one.
    """
    s = stored.select(*keys, F.col("value").alias("stored_value"), "status", F.lit(True).alias("_s"))
    f = fresh.select(*keys, F.col("value").alias("fresh_value"), F.lit(True).alias("_f"))
    both = s.join(f, keys, "full_outer").withColumns(measured or {})
    frozen = F.col("status").eqNullSafe("verified")
    action = (
        F.when(F.col("_s").isNull(), "insert")
        .when(F.col("_f").isNull(), F.when(frozen, "queue").otherwise("delete"))
        .when(frozen, F.when(distance > tolerance, "queue").otherwise("keep"))
        .when(F.col("stored_value").eqNullSafe(F.col("fresh_value")), "keep")
        .otherwise("update")
    )
    return both.withColumn("action", action).drop("_s", "_f")


def applied(actions: DataFrame, keys: list[str]) -> DataFrame:
    """The view after the refresh: (keys, value, status)."""
    value = F.when(F.col("action").isin("insert", "update"), F.col("fresh_value")).otherwise(F.col("stored_value"))
    return actions.where("action <> 'delete'").select(*keys, value.alias("value"), F.coalesce("status", F.lit("auto")).alias("status"))


def new_conflicts(actions: DataFrame, queue: DataFrame, keys: list[str]) -> DataFrame:
    """Queued rows that have no open entry of the same content yet."""
    found = actions.where("action = 'queue'").select(*keys, "stored_value", "fresh_value")
    entry = lambda df: df.withColumn("content", digest(*keys, "stored_value", "fresh_value"))
    return entry(found).join(entry(queue.where("status = 'open'")).select("content"), "content", "left_anti").drop("content")


def request_rechecks(queue: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The queue with each requested key at its next generation, from 1."""
    asked = keys.select(*names).distinct().withColumn("_ask", F.lit(1).cast("long"))
    both = queue.select(*names, "gen").join(asked, names, "full_outer")
    return both.select(*names, (F.coalesce("gen", F.lit(0).cast("long")) + F.coalesce("_ask", F.lit(0).cast("long"))).alias("gen"))


def clear_rechecks(queue: DataFrame, done: DataFrame, names: list[str]) -> DataFrame:
    """The queue less entries done at their present generation: a request made meanwhile survives."""
    return queue.join(done.select(*names, "gen"), [*names, "gen"], "left_anti")


def frame_status(frames: DataFrame, keys: list[str], marks: dict[str, DataFrame], default: str) -> DataFrame:
    """The first mark, in the order given, whose table has the frame."""
    out = frames
    for name, df in marks.items():
        out = out.join(df.select(*keys).distinct().withColumn(f"_{name}", F.lit(True)), keys, "left")
    status = F.coalesce(*[F.when(F.col(f"_{n}"), F.lit(n)) for n in marks], F.lit(default))
    return out.withColumn("status", status).drop(*[f"_{n}" for n in marks])


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows` replace those of `table` with equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def latest_versions(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(v).desc() for v in version])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
