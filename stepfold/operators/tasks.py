"""Dataset exports: annotation documents, question generators and their records."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions.text import opaque_id
from stepfold.operators.windows import hash_rank
from stepfold.session import cut, vocabulary


def annotation_ids(rows: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """Dense ids from 1 in a global order, without one task for all rows.

    Rows are range-partitioned and sorted by the order, in as many partitions as the session shuffles to, and kept, as
    the partitioning is drawn from a sample. A row's id is its place in its partition, which Spark's row numbering
    has in its low bits, plus the sizes of the partitions before it, a table of one row for each; nothing is shuffled
    again.
    """
    place = F.monotonically_increasing_id()
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = placed.withColumn("_part", F.shiftright(place, 33)).withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifted = placed.join(F.broadcast(sizes.select("_part", offset.alias("_offset"))), "_part")  # a row for each partition
    return shifted.withColumn(out, (F.col("_place") + F.col("_offset") + 1).cast("long")).drop("_part", "_place", "_offset")


def verified(frames: DataFrame, rows: DataFrame, keys: list[str], flag: str, status: str) -> DataFrame:
    """Frames whose flag is set or whose rows, one at least, are all verified."""
    g = rows.groupBy(*keys).agg(F.every(F.col(status) == "verified").alias("_all"))
    return frames.join(g, keys, "left").where(F.coalesce(F.col(flag), F.lit(False)) | F.coalesce("_all", F.lit(False))).drop("_all")


def record(rows: DataFrame, task: str, entity: str, step: str, question: Column, answer: Column) -> DataFrame:
    """The common record of all generators; the id is a digest of task, entity and step."""
    keyed = opaque_id("q_", task, F.col(entity), F.col(step))
    return rows.select(keyed.alias("id"), F.lit(task).alias("task"), F.col(entity).alias("entity"), F.col(step).alias("step"), question.alias("question"), answer.alias("answer"))


def visible_sets(rows: DataFrame, entity: str, step: str, name: str, task: str = "V1") -> DataFrame:
    """Everything there is at a step, sorted."""
    g = rows.groupBy(entity, step).agg(F.array_join(F.sort_array(F.collect_set(name)), ",").alias("all"))
    return record(g, task, entity, step, F.lit("Which are there?"), F.col("all"))


def state_questions(rows: DataFrame, entity: str, step: str, state: str, askable: list[str], task: str = "V2") -> DataFrame:
    return record(rows.where(F.col(state).isin(askable)), task, entity, step, F.lit("Which state?"), F.col(state))


def step_actions(rows: DataFrame, entity: str, step: str, label: str, task: str = "V3") -> DataFrame:
    """The change from the step numbered one less; steps without one are not asked."""
    before = rows.select(entity, (F.col(step) + 1).alias(step), F.col(label).alias("_was"))
    joined = rows.join(before, [entity, step])
    return record(joined, task, entity, step, F.concat(F.lit("What follows "), "_was", F.lit("?")), F.col(label))


def balanced_changes(rows: DataFrame, entity: str, step: str, label: str, task: str = "V12") -> DataFrame:
    """Changed or not, with as many of the larger side, by hash rank, as the smaller one has, for each entity."""
    before = rows.select(entity, (F.col(step) + 1).alias(step), F.col(label).alias("_was"))
    joined = rows.join(before, [entity, step]).withColumn("_changed", F.col(label) != F.col("_was"))
    w = Window.partitionBy(entity)
    least = F.least(F.count_if("_changed").over(w), F.count_if(~F.col("_changed")).over(w))
    ranked = joined.withColumn("_least", least).withColumn("_rank", hash_rank([entity, "_changed"], F.col(step).cast("string"), task))
    return record(ranked.where("_rank <= _least"), task, entity, step, F.lit("Did it change?"), F.when(F.col("_changed"), "yes").otherwise("no"))


def cross_view(rows: DataFrame, entity: str, step: str, view: str, label: str, task: str = "V15") -> DataFrame:
    """Pairs of views of one moment, each pair once: do they agree?"""
    a = rows.select(entity, step, F.col(view).alias("_a"), F.col(label).alias("_la"))
    b = rows.select(entity, step, F.col(view).alias("_b"), F.col(label).alias("_lb"))
    pairs = a.join(b, [entity, step]).where("_a < _b")
    return record(pairs, task, entity, step, F.concat_ws(" ", F.lit("Same in"), "_a", F.lit("and"), "_b"), F.when(F.col("_la") == F.col("_lb"), "yes").otherwise("no"))


def options(rows: DataFrame, entity: str, step: str, label: str, pool: DataFrame, k: int, task: str = "V6") -> DataFrame:
    """The next label among k others of the vocabulary `pool` (one row each), listed in hash order."""
    wrong = rows.join(vocabulary(pool.select(F.col(label).alias("_o"))), F.col(label) != F.col("_o"))
    ranked = wrong.withColumn("_r", hash_rank([entity, step], F.concat_ws("|", F.col(step).cast("string"), "_o"), task)).where(F.col("_r") <= k)
    g = ranked.groupBy(entity, step, label).agg(F.collect_list("_o").alias("_w"))
    shown = F.array_sort(F.concat("_w", F.array(label)))
    return record(g, task, entity, step, F.concat(F.lit("Next of: "), F.array_join(shown, ",")), F.col(label))


def progress_records(frames: DataFrame, actions: DataFrame, entity: str, step: str, bins: list[str]) -> DataFrame:
    """What is done by each frame, how much is left and in which part of the work the frame stands.

    Actions are (entity, step, verb, target) that succeeded. `done` is the sorted set of (verb, target) up to the step, the
    counts are of the log's actions, repeats included. An entity with an unnamed target (`?` or ending in `.?`) or
    without actions is not asked. Frames and actions are swept once in step order; a frame's record is as long as its
    answer.
    """
    unnamed = F.coalesce(F.max(F.col("target").isNull() | F.col("target").rlike(r"(^|\.)\?$")).over(Window.partitionBy(entity)), F.lit(True))
    named = actions.withColumn("_unnamed", unnamed).where("not _unnamed").select(entity, step, F.struct("verb", "target").alias("_did"))
    both = named.unionByName(frames.select(entity, step).distinct(), allowMissingColumns=True)
    upto, every = Window.partitionBy(entity).orderBy(step).rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy(entity)
    swept = both.withColumn("done", F.array_sort(F.collect_set("_did").over(upto))).withColumn("_n", F.count("_did").over(upto)).withColumn("total", F.count("_did").over(every))
    share = F.least(F.floor(F.col("_n") / F.col("total") * len(bins)), F.lit(len(bins) - 1)).cast("int")
    asked = swept.where("_did is null and total > 0")
    return asked.select(entity, step, "done", (F.col("total") - F.col("_n")).alias("remaining"), F.get(F.array(*[F.lit(b) for b in bins]), share).alias("bin"))


def export(generators: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """All records of the named generators."""
    return reduce(DataFrame.unionByName, [g() for g in generators.values()])


def id_collisions(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.countDistinct(F.struct("task", "entity", "step")).alias("n")).where("n > 1")
