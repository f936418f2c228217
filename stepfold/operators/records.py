"""Whole question records: question, answer, evidence, rationale chain, whether all of it is verified, and why it is true.

`by` names the moment asked about (such as machine, view, step). Boxes are (by, key, x0, y0, x1, y1, visibility,
verified) of what can be pointed at. An answer is a JSON object, a chain an array of (op, subject, detail).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions.text import opaque_id
from stepfold.operators.questions import ANSWERABLE, GRAPH, STATE, answerable_pairs, pick, referring
from stepfold.operators.state import gated_verbs, unmet

# What makes an answer true, beside the two causes of a certain no.
DEMONSTRATED, FAILED = "demonstrated", "failed_attempt"
NOTHING = "array<struct<op:string,subject:string,detail:string>>"


def thought(op: str, subject: Column, detail: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), subject.alias("subject"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail"))


def as_json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]), {"ignoreNullFields": "false"})


def finished(rows: DataFrame, task: str, by: Sequence[str], names: Sequence[str], templates: Sequence[str]) -> DataFrame:
    """Records of rows (by, label, answer, chain, keys, verified, negative, truth): the id and the wording follow from the
    task, the moment and `names`; the label stands where the wording has `{}`."""
    said = F.concat_ws("-", F.lit(task), *[F.col(c).cast("string") for c in [*by, *names]])
    question = F.replace(pick(list(templates), said), F.lit("{}"), F.coalesce("label", F.lit("")))
    return rows.select(opaque_id("q_", task, said).alias("id"), F.lit(task).alias("task"), *by, question.alias("question"), "answer", "chain", "evidence", "verified", "negative", "truth")


def with_evidence(rows: DataFrame, boxes: DataFrame, by: Sequence[str], names: Sequence[str], frames: DataFrame) -> DataFrame:
    """`rows` (by, names, keys) with `evidence`, the boxes of the keys that can be pointed at, by key, and `verified`: the
    frame's own (by, verified), or that of all its evidence where there is some."""
    box = F.struct(F.col("_key").alias("key"), F.array("x0", "y0", "x1", "y1").alias("box"))
    placed = boxes.select(*by, F.col("key").alias("_key"), "x0", "y0", "x1", "y1", F.col("verified").alias("_row"))
    named = rows.select(*by, *names, F.explode("keys").alias("_key")).distinct()
    found = named.join(placed, [*by, "_key"]).groupBy(*by, *names).agg(F.array_sort(F.collect_list(box)).alias("evidence"), F.every("_row").alias("_sure"))
    out = rows.join(found, [*by, *names], "left").join(frames.select(*by, F.col("verified").alias("_frame")), list(by), "left")
    empty = F.array().cast("array<struct<key:string,box:array<bigint>>>")
    return out.withColumn("evidence", F.coalesce(F.col("evidence").cast("array<struct<key:string,box:array<bigint>>>"), empty)).withColumn("verified", F.coalesce("_frame", F.lit(False)) | F.coalesce("_sure", F.lit(False)))


def feasibility(cases: DataFrame, state: DataFrame, edges: DataFrame, boxes: DataFrame, frames: DataFrame, by: Sequence[str], templates: Sequence[str]) -> DataFrame:
    """Can this be done now? cases: (by, verb, key, truth).

    Only what was demonstrated is a yes. A no names the blockers whose edges are unmet, and its chain recalls each edge,
    sees the blocker's state and finds it wanting. A failed attempt that no edge explains is not asked about.
    """
    of = [*by, "verb", "key"]
    bad = unmet(edges, state, by).select(*by, F.col("target").alias("key"), F.explode(gated_verbs(F.col("type"), F.col("mode"))).alias("verb"), "type", "blocker", "blocker_state")
    held = cases.where(F.col("truth") != DEMONSTRATED).join(bad, of).select(*of, "type", "blocker", "blocker_state").distinct()
    edge = F.struct("type", "blocker", "blocker_state")
    why = held.groupBy(*of).agg(F.array_sort(F.collect_list(edge)).alias("_edges"))
    rows = cases.join(why, of, "left").join(state.select(*by, "key", F.col("state").alias("_state")), [*by, "key"])
    rows = rows.where((F.col("truth") != FAILED) | F.col("_edges").isNotNull())
    edges_of = F.coalesce("_edges", F.array().cast("array<struct<type:string,blocker:string,blocker_state:string>>"))
    rows = rows.withColumn("_edges", edges_of)
    lines = lambda e: F.array(thought("recall_relation", F.col("key"), F.concat_ws(" ", e["type"], e["blocker"])), thought("observe", e["blocker"], e["blocker_state"]), thought("check_precondition", e["blocker"], F.lit("not met")))
    late = F.when(F.col("truth") == STATE, F.array(thought("check_precondition", F.col("key"), F.lit("not met")))).otherwise(F.array().cast(NOTHING))
    rows = rows.withColumn("chain", F.concat(F.array(thought("observe", F.col("key"), F.col("_state"))), F.flatten(F.transform("_edges", lines)), late))
    blockers = F.array_sort(F.array_distinct(F.transform("_edges", lambda e: e["blocker"])))
    yes = F.col("truth") == DEMONSTRATED
    reason = F.when(~yes, F.when(F.size("_edges") > 0, "violates_edge").otherwise("state"))
    rows = rows.withColumn("answer", as_json(feasible=yes, blockers=blockers, reason=reason)).withColumn("keys", F.concat(F.array("key"), blockers))
    rows = rows.withColumn("label", F.concat_ws(" ", "verb", "key")).withColumn("negative", F.when(~yes, F.col("truth")))
    return finished(with_evidence(rows, boxes, by, ["verb", "key", "truth"], frames), "V4", by, ["truth", "verb", "key"], templates)


def bounded(sets: DataFrame, boxes: DataFrame, frames: DataFrame, by: Sequence[str], templates: Sequence[str]) -> DataFrame:
    """What can be done now? sets: (by, must_include, must_not_include, permitted), `verb:key` lists joined by commas."""
    listed = lambda c: F.filter(F.split(c, ","), lambda x: x != "")
    keys = F.array_distinct(F.transform(listed("must_include"), lambda a: F.substring_index(a, ":", -1)))
    rows = sets.withColumn("answer", as_json(must_include=listed("must_include"), must_not_include=listed("must_not_include"), permitted_upper_bound=listed("permitted")))
    rows = rows.withColumn("keys", keys).withColumn("chain", F.transform("keys", lambda k: thought("observe", k, F.lit("possible")))).withColumn("label", F.lit(""))
    rows = rows.withColumn("negative", F.lit(None).cast("string")).withColumn("truth", F.lit("bounded"))
    return finished(with_evidence(rows, boxes, by, [], frames), "V5", by, [], templates)


def pointed(rows: DataFrame, by: Sequence[str], budget: int, templates: Sequence[str]) -> DataFrame:
    """Where is it? rows: boxes of verified frames with (cls, state): parts that one expression singles out, with the
    kind of expression as the truth."""
    asked = referring(rows, list(by), "key", budget).join(rows, [*by, "key"])
    box = F.array("x0", "y0", "x1", "y1")
    out = asked.withColumn("label", F.col("phrase")).withColumn("answer", as_json(instance=F.col("key"), bbox=box)).withColumn("chain", F.array(thought("observe", F.col("key"), F.col("visibility"))))
    out = out.withColumn("evidence", F.array(F.struct("key", box.cast("array<bigint>").alias("box")))).withColumn("negative", F.lit(None).cast("string")).withColumn("truth", F.col("family"))
    return finished(out, "V8", by, ["key"], templates)


def abstaining(rows: DataFrame, by: Sequence[str], budget: int, templates: Sequence[str]) -> DataFrame:
    """Which state is it in, or can it not be told? rows: (by, key, state, visibility, x0, y0, x1, y1, verified) of
    verified frames: as many parts that cannot be seen as parts that can, whose chain ends by abstaining."""
    chosen = answerable_pairs(rows, list(by), "key", budget)
    seen = F.col("visibility").isin(ANSWERABLE)
    chain = F.when(seen, F.array(thought("observe", F.col("key"), F.col("state")))).otherwise(F.array(thought("propagate_state", F.col("key"), F.lit(None)), thought("abstain", F.col("key"), F.col("visibility"))))
    box = F.struct("key", F.array("x0", "y0", "x1", "y1").cast("array<bigint>").alias("box"))
    out = chosen.withColumn("answer", as_json(answerable=seen, state=F.when(seen, F.col("state")))).withColumn("chain", chain).withColumn("label", F.col("key"))
    out = out.withColumn("evidence", F.when(seen, F.array(box)).otherwise(F.slice(F.array(box), 1, 0))).withColumn("negative", F.when(~seen, "unanswerable")).withColumn("truth", F.lit("visibility"))
    return finished(out, "V14", by, ["key"], templates)


__all__ = ["DEMONSTRATED", "FAILED", "GRAPH", "STATE", "abstaining", "bounded", "feasibility", "finished", "pointed", "with_evidence"]
