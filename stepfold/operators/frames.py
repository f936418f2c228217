"""The frame index: expected steps against capture listings, key frames with their parts, pose re-cut, keyed deletes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.operators.joins import forward_asof, overlaps
from stepfold.operators.recut import turned
from stepfold.session import tasks_for, vocabulary


def folder_step(path: Column) -> Column:
    """The nominal step number of a capture folder: the digits at the end of its name, null for none."""
    return F.nullif(F.regexp_extract(path, r"([0-9]+)$", 1), F.lit("")).cast("long")


def frame_index(steps: DataFrame, listings: dict[str, DataFrame], views: DataFrame) -> DataFrame:
    """(desktop, view, step, path, shots): every expected frame, with its first file and how many there are.

    listings: for each view (desktop, step, path). Frames without a file have a null path and no shots. Tasks are as many
    as the expected frames need.
    """
    frame = ["desktop", "view", "step"]
    tasks = tasks_for(steps, len(listings))
    every = reduce(DataFrame.unionByName, [df.select("desktop", F.lit(view).alias("view"), "step", "path") for view, df in listings.items()])
    found = every.repartition(tasks, *frame).groupBy(*frame).agg(F.min("path").alias("path"), F.count("*").alias("shots"))
    expected = steps.select("desktop", "step").join(vocabulary(views.select("view"))).repartition(tasks, *frame)
    return expected.join(found, frame, "left").select("desktop", "view", "step", "path", F.coalesce("shots", F.lit(0)).alias("shots"))


def stray_files(steps: DataFrame, listing: DataFrame) -> DataFrame:
    """Files of steps that no log expects."""
    return listing.join(steps.select("desktop", "step"), ["desktop", "step"], "left_anti")


def index_report(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """(desktop, view, present, missing, gaps): counts, and the missing steps as ranges. tasks: that the desktops are dealt to."""
    index = index if tasks is None else index.repartition(tasks, "desktop", "view")
    run = F.col("step") - F.row_number().over(Window.partitionBy("desktop", "view").orderBy("step"))
    gaps = index.where("path is null").withColumn("_run", run).groupBy("desktop", "view", "_run").agg(F.min("step").alias("a"), F.max("step").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")))
    listed = gaps.groupBy("desktop", "view").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))), lambda g: g["t"]), ",").alias("gaps"))
    counts = index.groupBy("desktop", "view").agg(F.count("path").alias("present"), F.count_if(F.col("path").isNull()).alias("missing"))
    return counts.join(listed, ["desktop", "view"], "left").withColumn("gaps", F.coalesce("gaps", F.lit("")))


def index_documents(index: DataFrame, tasks: int | None = None) -> DataFrame:
    """(desktop, doc): one JSON document for each desktop, frames by view and step. tasks: that the desktops are dealt to."""
    index = index if tasks is None else index.repartition(tasks, "desktop")
    frames = F.sort_array(F.collect_list(F.struct("view", "step", "path", "shots")))
    return index.groupBy("desktop").agg(F.to_json(F.struct(frames.alias("frames"))).alias("doc"))


FRAMES = "frames array<struct<view: string, step: bigint, path: string, shots: bigint>>"


def from_documents(docs: DataFrame) -> DataFrame:
    """The index read back; a document that does not parse has no frames."""
    return docs.select("desktop", F.explode(F.from_json("doc", FRAMES)["frames"]).alias("f")).select("desktop", "f.view", "f.step", "f.path", "f.shots")


def merged_aux(stored: Column, new: Column, owned: list[str]) -> Column:
    """Map union where the new side wins, but for the keys that only the stored side may set."""
    kept = F.map_filter(stored, lambda k, v: k.isin(owned) | ~F.map_contains_key(new, k))
    return F.map_concat(kept, F.map_filter(new, lambda k, v: ~F.map_contains_key(kept, k)))


def with_parts(keyframes: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """Key frames with the array of their parts in order, one join for all of them; those without parts are left out."""
    g = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "part"))).alias("parts"))
    return keyframes.join(g, key)


def bump(keyframes: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Append-only update: every change becomes a row of the next version of its key, from 1."""
    last = keyframes.groupBy(*keys).agg(F.max("version").alias("_last"))
    new = changes.join(last, keys, "left").withColumn("version", F.coalesce("_last", F.lit(0)).cast("long") + 1).drop("_last")
    return keyframes.unionByName(new.select(*keyframes.columns))


def delete_where(rows: DataFrame, keys: DataFrame, names: list[str], guard: DataFrame | None = None) -> DataFrame:
    """`rows` less those of the listed keys; keys that `guard` holds are not deleted."""
    doomed = keys.select(*names).distinct()
    doomed = doomed if guard is None else doomed.join(guard.select(*names), names, "left_anti")
    return rows.join(doomed, names, "left_anti")


def replace_source(rows: DataFrame, fresh: DataFrame, source: str) -> DataFrame:
    """A re-runnable import: all rows of the source go, the fresh ones come."""
    return rows.where(~F.col("source").eqNullSafe(F.lit(source))).unionByName(fresh.withColumn("source", F.lit(source)).select(*rows.columns))


def order_references(orders: DataFrame, key: str) -> DataFrame:
    """(key, n): in how many layer orders (JSON arrays of [key, part]) a key stands; text that does not parse has none."""
    each = orders.select(F.explode(F.array_distinct(F.transform(F.from_json("layers", "array<array<string>>"), lambda e: F.get(e, 0)))).alias(key))
    return each.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def merge_orders(keeper: Column, other: Column) -> Column:
    """The keeper's order, then what only the other has, in its order."""
    return F.array_union(keeper, other)


def turned_pairs(rows: DataFrame, keys: list[str], keeper: str, other: str) -> DataFrame:
    """(keys, above, below): pairs that `other` orders one way and the merged order the other way."""
    pairs = turned(merge_orders(F.col(keeper), F.col(other)), F.col(other))
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.above", "p.below")


def recut_keeper(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """For each new segment (keys, seg, start, end) the old one that it overlaps most, the earlier at a tie."""
    both = overlaps(old.select(*keys, "seg", "start", "end"), new.select(*keys, "seg", "start", "end"), keys).withColumn("overlap", F.col("b") - F.col("a") + 1)
    best = F.max_by(F.struct(F.col("left.seg").alias("old_seg"), "overlap"), F.struct("overlap", -F.col("left.start")))
    return both.groupBy(*keys, F.col("right.seg").alias("seg")).agg(best.alias("b"), F.count("*").alias("contributors")).select(*keys, "seg", "b.old_seg", "b.overlap", "contributors")


def rekeyed(anchored: DataFrame, segments: DataFrame, keys: list[str], anchor: str) -> DataFrame:
    """Anchored rows (key frames, overrides) with the segment whose range has their anchor: one sweep by step."""
    ends = segments.select(*keys, F.col("end").alias("_end"), F.col("seg").alias("_seg"), F.col("start").alias("_start"))
    out = forward_asof(anchored, ends, keys, anchor, "_end", [F.col("_seg")])
    hit = F.col("version._start") <= F.col(anchor)
    return out.withColumn("seg", F.when(hit, F.col("version._seg"))).drop("version")


def proposals(rows: DataFrame, least_px: float, all_views: list[str]) -> DataFrame:
    """Audit rows (desktop, step, kind, view, px) as proposed breaks: a moved chassis concerns every view."""
    wanted = F.when(F.col("kind") == "chassis", F.array(*[F.lit(v) for v in all_views])).otherwise(F.array("view"))
    return rows.where(F.col("px") >= least_px).select("desktop", "step", F.explode(wanted).alias("view"), "px").groupBy("desktop", "step", "view").agg(F.max("px").alias("px"))


def import_proposals(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored proposals and the fresh ones that have no row yet: no decision is ever overwritten."""
    new = fresh.join(stored.select(*keys), keys, "left_anti").withColumn("status", F.lit("proposed"))
    return stored.unionByName(new.select(*stored.columns))
