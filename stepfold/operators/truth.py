"""Compiled frames and their confirmation: key-frame choice, stacking of boxes, labels, conflicts, refusals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions.text import visibility
from stepfold.operators.joins import forward_asof
from stepfold.session import tasks_for

# Hand resolutions of a conflict, the labels that a confirmed row states, the order of refusals.
RESOLUTIONS = ["keep_old", "accept_new", "edited"]
LABEL_FIELDS = ["visibility", "placement"]
REFUSALS = ["conflict", "problem", "frozen"]


def placement_of(given: Column, geometry: Column) -> Column:
    """The recorded placement, else the bench for boxes and the chassis for masks."""
    return F.coalesce(given, F.when(geometry == "box", "on_bench").otherwise("in_chassis"))


def chosen_keyframes(needs: DataFrame, keyframes: DataFrame) -> DataFrame:
    """(frame keys, instance, placement, segment, x0..y1, version): the shape that each needed instance has at its step.

    The next key frame at or after the step of the same view, placement chain and pose segment, the newest version
    first; instances without one have null edges (a missing shape). Tasks are as many as both tables' rows need.
    """
    by = ["desktop", "view", "instance", "placement", "segment"]
    dealt = keyframes.repartition(tasks_for(keyframes), *by)
    out = forward_asof(needs, dealt, by, "step", "anchor", [F.col("version").desc()], tasks_for(needs))
    edges = ["x0", "y0", "x1", "y1"]
    return out.select(*needs.columns, *[F.col(f"version.{e}").alias(e) for e in edges], F.col("version.version").alias("keyframe_version"))


def compiled_boxes(shapes: DataFrame, frame: list[str], layer: str, cell: int = 256) -> DataFrame:
    """`shapes` (frame keys, instance, placement, x0..y1, layer) with occlusion, visibility and occluders.

    Parts of one placement cover those of lower layers; a box is as hidden as the largest single cover makes it. Boxes
    are dealt to grid cells, and only those that share a cell are compared: the pair is made in the first shared cell.
    """
    key = [*frame, "placement"]
    cells = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))
    drawn = shapes.where("x1 > x0 and y1 > y0")
    dealt = drawn.withColumn("cx", F.explode(cells("x0", "x1"))).withColumn("cy", F.explode(cells("y0", "y1")))
    over = dealt.select(*key, "cx", "cy", F.col("instance").alias("_by"), F.col(layer).alias("_layer"), *[F.col(e).alias(f"_{e}") for e in ("x0", "y0", "x1", "y1")])
    w, h = F.least("x1", "_x1") - F.greatest("x0", "_x0"), F.least("y1", "_y1") - F.greatest("y0", "_y0")
    first = (F.col("cx") == F.floor(F.greatest("x0", "_x0") / cell)) & (F.col("cy") == F.floor(F.greatest("y0", "_y0") / cell))
    pairs = dealt.join(over, [*key, "cx", "cy"]).where((F.col("_layer") > F.col(layer)) & (w > 0) & (h > 0) & first)
    share = w * h / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    hidden = pairs.groupBy(*frame, "instance").agg(F.max(share).alias("occlusion"), F.count("*").alias("covers"))
    out = shapes.join(hidden, [*frame, "instance"], "left").withColumn("occlusion", F.coalesce("occlusion", F.lit(0.0))).withColumn("covers", F.coalesce("covers", F.lit(0)))
    side = F.when((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return out.withColumn("visibility", visibility(side, F.col("occlusion")))


def row_values(compiled: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Compiled instances as truth rows: a frame override's visibility wins and is marked as forced."""
    given = overrides.select(*keys, F.col("visibility").alias("_said"))
    out = compiled.join(given, keys, "left")
    return out.withColumn("forced", F.col("_said").isNotNull()).withColumn("visibility", F.coalesce("_said", "visibility")).drop("_said")


def label_changes(stored: DataFrame, compiled: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, old, new) where a confirmed row's label no longer holds.

    Placement always counts; visibility only where a person stated it, in the stored row or now (`forced`). A stored
    null is not recorded and disagrees with nothing.
    """
    new = compiled.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*LABEL_FIELDS, "forced")])
    both = stored.join(new, keys)
    stated = F.coalesce(F.col("forced"), F.lit(False)) | F.coalesce(F.col("_forced"), F.lit(False))
    field = lambda c, when: F.when(when & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.struct(F.lit(c).alias("field"), F.col(c).alias("old"), F.col(f"_{c}").alias("new")))
    found = F.array_compact(F.array(field("visibility", stated), field("placement", F.lit(True))))
    return both.withColumn("_f", F.explode(found)).select(*keys, "_f.field", "_f.old", "_f.new")


def resolve_conflicts(conflicts: DataFrame, decisions: DataFrame, current: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Open conflicts (cid, keys, old, new) after hand decisions (cid, resolution): with `status`, the row's `value` and `pin`.

    keep_old pins the frozen value as a frame override. accept_new takes the current value if it agrees with the queued
    one, else the conflict is superseded and stays open about the current value. edited only closes. Conflicts without a
    decision, or with an unknown one, stay open.
    """
    now = current.select(*keys, F.col("value").alias("_now"))
    both = conflicts.join(decisions, "cid", "left").join(now, keys, "left")
    agrees = F.coalesce(F.abs(F.col("_now") - F.col("new")) <= tolerance, F.col("_now").isNull() & F.col("new").isNull())
    status = F.when(F.col("resolution") == "accept_new", F.when(agrees, "accepted").otherwise("superseded")).when(F.col("resolution") == "keep_old", "kept").when(F.col("resolution") == "edited", "edited").otherwise("open")
    out = both.withColumn("status", status)
    value = F.when(F.col("status") == "accepted", F.col("_now")).otherwise(F.col("old"))
    return out.select("cid", *keys, "status", value.alias("value"), (F.col("status") == "kept").alias("pin"), F.when(F.col("status") == "superseded", F.col("_now")).alias("requeued"))


def blockers(conflicts: DataFrame, problems: DataFrame, frozen: DataFrame, frame: list[str], thorough: bool) -> DataFrame:
    """(frame, kind, instance): why a frame cannot be confirmed.

    thorough: of each frame the first category that has anything. Otherwise every category, with a frozen disagreement
    left out where the part has an open conflict already.
    """
    named = lambda df, kind: df.select(*frame, F.lit(kind).alias("kind"), "instance")
    if not thorough:
        frozen = frozen.join(conflicts.select(*frame, "instance"), [*frame, "instance"], "left_anti")
    every = reduce(DataFrame.unionByName, [named(df, kind) for kind, df in zip(REFUSALS, (conflicts, problems, frozen))])
    if not thorough:
        return every
    rank = F.array_position(F.array(*[F.lit(k) for k in REFUSALS]), F.col("kind"))
    first = F.min(rank).over(Window.partitionBy(*frame))
    return every.withColumn("_first", first).where(rank == F.col("_first")).drop("_first")


def confirm(frames: DataFrame, asked: DataFrame, refusals: DataFrame, keys: list[str]) -> DataFrame:
    """Frames after confirmation requests (keys, digest): verified where nothing refuses and the inputs' digest is still
    the one that was looked at; `outcome` says verified, refused, moved or null for frames not asked about."""
    want = asked.select(*keys, F.col("digest").alias("_seen"), F.lit(True).alias("_asked"))
    refused = refusals.select(*keys).distinct().withColumn("_no", F.lit(True))
    both = frames.join(want, keys, "left").join(refused, keys, "left")
    outcome = F.when(F.col("_asked"), F.when(F.col("_no"), "refused").when(~F.col("digest").eqNullSafe(F.col("_seen")), "moved").otherwise("verified"))
    out = both.withColumn("outcome", outcome)
    return out.withColumn("status", F.when(F.col("outcome") == "verified", "verified").otherwise(F.col("status"))).drop("_seen", "_asked", "_no")


def demote(rows: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the listed frames are no longer confirmed; all else stays."""
    marked = rows.join(frames.select(*keys).distinct().withColumn("_d", F.lit(True)), keys, "left")
    return marked.withColumn("status", F.when(F.col("_d") & (F.col("status") == "verified"), "auto").otherwise(F.col("status"))).drop("_d")
