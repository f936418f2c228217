"""Pose re-cut: one operation that cuts the segments of many views anew and moves all that hangs on them.

`by` names a view (such as machine, view). Segments are (by, seg, start, end, ref) with the drawings of GEOMETRY, which
belong to the reference step, and the rectangles of BOXES, as text. The old segments of a view do not overlap and its
steps begin at 1. Boundaries are whole: a re-cut derives the segments again, so a second one changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.operators.joins import interval_lookup, overlaps
from stepfold.session import cut, shuffled

# What belongs to a segment's reference step, what to its picture, the mark of a copied key frame and the
# movement (pixels) below which a rectangle is still the right window.
GEOMETRY, BOXES = ("corners", "homography"), ("roi", "bench_roi")
CARRIED, SMALL_PX = "carried", 25.0


def boundaries(segments: DataFrame, reorients: DataFrame, breaks: DataFrame, by: Sequence[str], below: float = SMALL_PX) -> DataFrame:
    """(by, step, small): where each view should be cut: its accepted breaks (by, step, status, px) and the turns of its
    machine (a part of `by`, step), from step 2 to its last. `small` are breaks with a measured movement under `below`."""
    ends = shuffled(segments.where(_ranged()).groupBy(*by).agg(F.max("end").alias("_n")))
    shared = [c for c in by if c in reorients.columns]
    turns = ends.join(reorients.select(*shared, "step"), shared).select(*by, "step", F.lit(False).alias("small"))
    accepted = breaks.where("status = 'accepted'").select(*by, "step", F.coalesce(F.col("px") < below, F.lit(False)).alias("small"))
    every = turns.union(accepted).groupBy(*by, "step").agg(F.max("small").alias("small"))
    return every.join(ends, list(by)).where("step > 1 and step <= _n").drop("_n")


def ranges(segments: DataFrame, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, seg, start, end, small) of the new cut, numbered from 1; `small` tells of the boundary at the start."""
    ends = shuffled(segments.where(_ranged()).groupBy(*by).agg(F.max("end").alias("_n")))
    inner = bounds.join(ends, list(by)).where("step > 1 and step <= _n").groupBy(*by, F.col("step").alias("start"), "_n").agg(F.max("small").alias("small"))
    starts = ends.select(*by, F.lit(1).cast("long").alias("start"), "_n", F.lit(False).alias("small")).unionByName(inner)
    w = Window.partitionBy(*by).orderBy("start")
    return starts.select(*by, F.row_number().over(w).cast("long").alias("seg"), "start", F.coalesce(F.lead("start").over(w) - 1, F.col("_n")).alias("end"), "small")


def turned(merged: Column, other: Column) -> Column:
    """[(above, below)]: pairs that `other` orders one way and `merged`, which has all of them, the other way."""
    placed = F.transform(F.array_distinct(other), lambda e, i: F.struct(e.alias("e"), i.alias("i"), F.array_position(merged, e).alias("m")))
    below = lambda x: F.transform(F.filter(placed, lambda y: (y["i"] > x["i"]) & (y["m"] < x["m"])), lambda y: F.struct(x["e"].alias("above"), y["e"].alias("below")))
    return F.flatten(F.transform(placed, below))


def recut(segments: DataFrame, bounds: DataFrame, by: Sequence[str], *, keyframes: DataFrame, parts: DataFrame, orders: DataFrame, pairs: DataFrame, frames: DataFrame, frozen: DataFrame, carry: DataFrame, chain: Sequence[str] = ("instance", "placement")) -> dict[str, DataFrame]:
    """All tables of the views after the re-cut, and what it reports.

    keyframes (by, id, chain, seg, anchor, source, version, edits), parts (id, ..), orders (by, seg, layers, version),
    pairs (by, seg, above, below), frames (by, step, seg) and frozen (by, step). Ids are text and unique. Extra columns of key
    frames and parts come along. carry (by, step): new boundaries across which shapes are copied.

    - `segments`: a piece keeps the stored reference step that it holds, with the drawings; any other refers to its last
      step. Of merged pieces the keeper is the one that holds its reference step, with drawings before without, the
      latest first. Rectangles go to pieces that only small boundaries part from the reference step; where the keeper has
      none, the contributor's with the latest reference step is taken.
    - `keyframes`, `parts`: a shape goes where its anchor lies, else with the first step of its segment. A boundary of
      `carry` copies shapes that cover both sides to the step before it; copies of a boundary that is gone are deleted
      unless they were worked on.
    - `orders`, `pairs`: a split copies, a merge appends what only the others have, and unites the pairs. Rows of unknown
      segments stay, but for those that stand on a number that is written now.
    - `frames`: a frame that names its segment follows it.
    - `rechecks` (by, step): frozen steps of segments whose range changed or whose drawings were dropped.
    - `changed` (by): the views that were touched. A view that is already cut like this, with each reference step inside
      its segment, is not, nor is one without a range; rows without one go when their view is cut.
    - `moves` (by, seg, old_seg, ref, dropped), `discarded` (by, old_seg, into, field, value), `turned_pairs` (by, old_seg, into,
      above, below), `orphans` (by, kind, seg, replaced) and `kept_copies` (by, id): what could not stay as it was.
    """
    by = list(by)
    known = segments.where(_ranged())
    plan, fresh = _plan(segments, known, bounds, by)
    home = plan.groupBy(*by, F.col("old_seg").alias("seg")).agg(F.min_by("seg", "a").alias("_home"))

    chosen, kept, moves, discarded = _segments(known, plan, fresh, by)
    out = {"changed": fresh.select(*by).distinct(), "moves": moves, "discarded": discarded}
    out["segments"] = segments.join(out["changed"], by, "left_anti").unionByName(chosen.select(*segments.columns))
    out |= _layers(orders, pairs, plan, fresh, home, kept, by)
    out |= _keyframes(keyframes, parts, plan, fresh, home, carry, by, list(chain))

    pieces = plan.select(*by, F.col("old_seg").alias("seg"), "a", "b", F.col("seg").alias("_new"))
    named = interval_lookup(frames.join(home, [*by, "seg"], "left"), pieces, [*by, "seg"], "step", "a", "b", "_new", F.lit(None).cast("long"), F.coalesce("_home", "seg"))
    out["frames"] = named.withColumn("seg", F.col("segment")).select(*frames.columns)

    same = (F.col("start") == F.col("old_start")) & (F.col("end") == F.col("old_end"))
    redrawn = plan.groupBy(*by, "old_seg", "old_start", "old_end").agg(F.max(same).alias("_same")).where("not _same").select(*by, F.col("old_start").alias("a"), F.col("old_end").alias("b"))
    dropped = moves.where("dropped").join(fresh.select(*by, "seg", "start", "end"), [*by, "seg"]).select(*by, F.col("start").alias("a"), F.col("end").alias("b"))
    steps = redrawn.union(dropped).select(*by, F.explode(F.sequence("a", "b")).alias("step"))
    out["rechecks"] = frozen.select(*by, "step").distinct().join(shuffled(steps), [*by, "step"], "left_semi")
    return out


def _ranged() -> Column:
    return F.col("start").isNotNull() & F.col("end").isNotNull()


def _plan(segments: DataFrame, known: DataFrame, bounds: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Pieces (by, old_seg, old_start, old_end, seg, start, end, small, a, b) and new ranges of the views that change.

    Both have a row for each segment at most twice over, and are kept, as every table is moved by them, without broadcasts."""
    new = ranges(segments, bounds, by)
    both = overlaps(known.select(*by, "seg", "start", "end"), new, by)
    pieces = both.select(*by, *[F.col(f"left.{c}").alias(f"old_{c}") for c in ("seg", "start", "end")], "right.*", "a", "b")
    same = F.count_if((F.col("old_seg") == F.col("seg")) & (F.col("old_start") == F.col("start")) & (F.col("old_end") == F.col("end")))
    broken = ~F.coalesce(F.col("ref").between(F.col("start"), F.col("end")), F.lit(False))
    stored = segments.groupBy(*by).agg(F.count("*").alias("_rows"), F.max(broken).alias("_broken"))
    wanted = new.groupBy(*by).agg(F.count("*").alias("_new"))
    state = wanted.join(shuffled(stored), by).join(shuffled(pieces.groupBy(*by).agg(same.alias("_same"))), by, "left")
    active = shuffled(state.where("_broken or not (_rows <=> _same and _new <=> _same)").select(*by))
    return shuffled(cut(pieces.join(active, by, "left_semi"))), shuffled(cut(new.join(active, by, "left_semi")))


def _segments(known: DataFrame, plan: DataFrame, fresh: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """New segment rows, (by, seg, keeper), moved reference steps and what was lost."""
    rows = plan.join(known.select(*by, F.col("seg").alias("old_seg"), "ref", *GEOMETRY, *BOXES), [*by, "old_seg"])
    of_old = Window.partitionBy(*by, "old_seg")
    holds = F.coalesce(F.col("ref").between(F.col("start"), F.col("end")), F.lit(False))
    rows = rows.withColumn("_large", F.sum((~F.col("small")).cast("int")).over(of_old.orderBy("a")))
    near = F.col("_large") == F.max(F.struct(holds.alias("holds"), "a", "_large")).over(of_old)["_large"]
    drawn = F.coalesce(*GEOMETRY).isNotNull()
    rank = F.when(holds & drawn, 2).when(holds, 1).otherwise(0)
    order = F.struct(rank, F.when(holds, F.col("ref")).otherwise(F.col("a")), -F.col("a"))
    spare = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce("ref", F.lit(0)), "old_seg"))).alias(f"_{c}") for c in BOXES]
    rows = rows.withColumn("_near", near)
    picked = rows.groupBy(*by, "seg").agg(F.max_by(F.struct("old_seg", "ref", "_near", *GEOMETRY, *BOXES), order).alias("k"), *spare)
    joined = fresh.join(picked, [*by, "seg"], "left")
    stays = F.coalesce(F.col("k.ref").between(F.col("start"), F.col("end")), F.lit(False))
    boxes = [F.when(F.coalesce("k._near", F.lit(True)), F.coalesce(f"k.{c}", f"_{c}")).alias(c) for c in BOXES]
    new = joined.select(*by, "seg", "start", "end", F.when(stays, F.col("k.ref")).otherwise(F.col("end")).alias("ref"), *[F.when(stays, F.col(f"k.{c}")).alias(c) for c in GEOMETRY], *boxes, "k", stays.alias("_stays"))
    keeper = new.where("k is not null").select(*by, "seg", F.col("k.old_seg").alias("_keeper"))
    moves = new.where("k is not null and not _stays").select(*by, "seg", F.col("k.old_seg").alias("old_seg"), "ref", F.coalesce(*[F.col(f"k.{c}") for c in GEOMETRY]).isNotNull().alias("dropped"))
    now = new.select(*by, "seg", F.col("k.old_seg").alias("_keeper"), *[F.col(f"k.{c}").alias(f"_now_{c}") for c in GEOMETRY], *[F.col(c).alias(f"_now_{c}") for c in BOXES])
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value"), F.col(f"_now_{c}").alias("now")) for c in (*GEOMETRY, *BOXES)])
    lost = rows.join(shuffled(now), [*by, "seg"]).where("old_seg <> _keeper").select(*by, "old_seg", F.col("seg").alias("into"), F.explode(fields).alias("f"))
    return new.drop("k", "_stays"), shuffled(keeper), moves, lost.where("f.value is not null and not f.value <=> f.now").select(*by, "old_seg", "into", "f.field", "f.value")


def _layers(orders: DataFrame, pairs: DataFrame, plan: DataFrame, fresh: DataFrame, home: DataFrame, keeper: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    at = [*by, "seg"]
    target = plan.select(*by, F.col("old_seg").alias("seg"), F.col("seg").alias("_to"), "a")
    rows = orders.join(target, at).withColumnsRenamed({"seg": "old_seg", "_to": "seg"}).join(keeper, at)
    first = F.col("old_seg") == F.col("_keeper")
    others = F.array_sort(F.collect_list(F.when(~first, F.struct("a", "old_seg", "layers"))))  # the pieces of one segment
    g = rows.groupBy(*at).agg(F.max_by(F.struct("layers", "version"), F.when(first, 1)).alias("k"), others.alias("others"))
    whole = F.aggregate("others", F.coalesce(F.array_distinct("k.layers"), F.array().cast(orders.schema["layers"].dataType)), lambda acc, o: F.array_union(acc, o["layers"]))
    merged = shuffled(g).select(*at, F.when(F.size("others") == 0, F.col("k.layers")).otherwise(whole).alias("layers"), F.coalesce("k.version", F.lit(1)).alias("version"), "others")
    each = merged.select(*by, F.col("seg").alias("into"), "layers", F.explode("others").alias("o"))
    told = each.select(*by, F.col("o.old_seg").alias("old_seg"), "into", F.explode(turned(F.col("layers"), F.col("o.layers"))).alias("p"))
    loose_orders, loose_pairs = orders.join(home, at, "left_anti"), pairs.join(home, at, "left_anti")
    moved = pairs.join(target, at).select(*by, F.col("_to").alias("seg"), "above", "below").distinct()
    written = fresh.select(*at)
    views = fresh.select(*by).distinct()

    def orphans(loose: DataFrame, kind: str, replaced: DataFrame) -> DataFrame:
        here = loose.join(views, by, "left_semi").select(*at).distinct()
        return here.join(replaced.select(*at), at, "left_semi").select(*by, F.lit(kind).alias("kind"), "seg", F.lit(True).alias("replaced")).union(
            here.join(written, at, "left_anti").select(*by, F.lit(kind), "seg", F.lit(False)))

    return {
        "orders": merged.select(*orders.columns).union(loose_orders.join(merged.select(*at), at, "left_anti").select(*orders.columns)),
        "pairs": moved.select(*pairs.columns).union(loose_pairs.join(written, at, "left_anti").select(*pairs.columns)),
        "turned_pairs": told.select(*by, "old_seg", "into", "p.above", "p.below"),
        "orphans": orphans(loose_orders, "orders", merged).union(orphans(loose_pairs, "pairs", written)),
    }


def _keyframes(keyframes: DataFrame, parts: DataFrame, plan: DataFrame, fresh: DataFrame, home: DataFrame, carry: DataFrame, by: list[str], chain: list[str]) -> dict[str, DataFrame]:
    old_starts = plan.where("old_start > 1").select(*by, F.col("old_start").alias("step")).distinct()
    new_starts = fresh.where("start > 1").select(*by, F.col("start").alias("step"))
    gone = old_starts.join(new_starts, [*by, "step"], "left_anti")
    fresh_cuts = new_starts.join(old_starts, [*by, "step"], "left_anti").join(shuffled(carry.select(*by, "step")), [*by, "step"], "left_semi")

    ours = keyframes.withColumnRenamed("version", "_version")  # the lookup has a column of that name
    placed = interval_lookup(ours.join(home, [*by, "seg"], "left"), fresh, by, "anchor", "start", "end", "seg", F.lit(None).cast("long"), F.col("_home")).withColumnRenamed("_version", "version")
    rekeyed = placed.withColumn("seg", F.when(F.col("_home").isNotNull(), F.col("segment")).otherwise(F.col("seg"))).select(*keyframes.columns)
    doomed = keyframes.where(F.col("source") == CARRIED).join(shuffled(gone.select(*by, (F.col("step") - 1).alias("anchor"))), [*by, "anchor"]).select(*by, "id", ((F.col("version") <= 1) & (F.col("edits") <= 0)).alias("_go"))
    deleted = shuffled(doomed.where("_go").select("id").distinct())

    before = Window.partitionBy(*by, *chain, "seg").orderBy("anchor").rangeBetween(Window.unboundedPreceding, -1)
    begins = plan.groupBy(*by, F.col("old_seg").alias("seg")).agg(F.first("old_start").alias("_start"))
    covered = keyframes.join(begins, [*by, "seg"]).withColumn("_low", F.coalesce(F.max("anchor").over(before) + 1, F.col("_start")))
    cuts = shuffled(fresh_cuts.groupBy(*by).agg(F.collect_set("step").alias("_cuts")))  # the new boundaries of one view
    across = covered.join(cuts, by).withColumn("_at", F.explode(F.filter("_cuts", lambda c: (c > F.col("_low")) & (c <= F.col("anchor")))))
    sides = fresh.select(*by, (F.col("end") + 1).alias("_at"), F.col("seg").alias("_side"))
    new_id = F.concat("id", F.lit("@"), (F.col("_at") - 1).cast("string"))
    copies = across.join(sides, [*by, "_at"]).withColumn("_from", F.col("id"))
    fresh_values = {"id": new_id, "seg": F.col("_side"), "anchor": F.col("_at") - 1, "source": F.lit(CARRIED), "version": F.lit(1), "edits": F.lit(0)}
    kinds = {f.name: f.dataType for f in keyframes.schema}
    copies = copies.select("_from", *[fresh_values[c].cast(kinds[c]).alias(c) if c in fresh_values else F.col(c) for c in keyframes.columns])
    copied = parts.withColumnRenamed("id", "_from").join(shuffled(copies.select("_from", "id")), "_from").select(*parts.columns)
    return {
        "keyframes": rekeyed.join(deleted, "id", "left_anti").select(*keyframes.columns).unionByName(copies.drop("_from")),
        "parts": parts.join(deleted, "id", "left_anti").select(*parts.columns).union(copied),
        "kept_copies": doomed.where("not _go").select(*by, "id"),
    }
