"""Joins: as-of, intervals, tolerances, reconciliation. Equi-keys always lead, so no join is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_asof(left: DataFrame, versions: DataFrame, by: list[str], at: str, anchor: str, prefer: list[Column], tasks: int | None = None) -> DataFrame:
    """Each left row with the version of smallest `anchor` at or after `at`; ties by `prefer`; null where none is.

    Both sides are stacked and swept backwards in one sort by (key, position), so a key with many versions costs no
    product. `left` columns and `version` (a struct of the version's columns) come back. tasks: that the keys are dealt to for
    the sweep, else as many as Spark sees fit.
    """
    best = versions.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, anchor).orderBy(*prefer))).where("_rank = 1").drop("_rank")
    kind = best.select(F.struct(*best.columns).alias("v")).schema["v"].dataType
    rows = left.select(*by, F.col(at).alias("_at"), F.struct(*left.columns).alias("row"), F.lit(None).cast(kind).alias("v"))
    vers = best.select(*by, F.col(anchor).alias("_at"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct(*best.columns).alias("v"))
    sweep = Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.union(vers)
    swept = (both if tasks is None else both.repartition(tasks, *by)).withColumn("version", F.last("v", ignorenulls=True).over(sweep)).where("row is not null")
    return swept.select("row.*", "version")


def backward_asof(left: DataFrame, versions: DataFrame, by: list[str], at: str, anchor: str, prefer: list[Column]) -> DataFrame:
    """As `forward_asof`, with the largest anchor at or before `at`."""
    best = versions.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, anchor).orderBy(*prefer))).where("_rank = 1").drop("_rank")
    kind = best.select(F.struct(*best.columns).alias("v")).schema["v"].dataType
    rows = left.select(*by, F.col(at).alias("_at"), F.struct(*left.columns).alias("row"), F.lit(None).cast(kind).alias("v"))
    vers = best.select(*by, F.col(anchor).alias("_at"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.struct(*best.columns).alias("v"))
    sweep = Window.partitionBy(*by).orderBy("_at", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.union(vers).withColumn("version", F.last("v", ignorenulls=True).over(sweep)).where("row is not null")
    return swept.select("row.*", "version")


def inverse_asof(left: DataFrame, versions: DataFrame, by: list[str], at: str, anchor: str, prefer: list[Column], version_id: str) -> DataFrame:
    """For each version that is chosen at all, how many rows choose it and over which positions."""
    chosen = forward_asof(left, versions, by, at, anchor, prefer).where("version is not null")
    return chosen.groupBy(F.col(f"version.{version_id}").alias(version_id)).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def interval_lookup(left: DataFrame, ranges: DataFrame, by: list[str], at: str, start: str, end: str, seg: str, override: Column, default: Column) -> DataFrame:
    """`segment`: the row's own override, else the `seg` whose range holds `at`, else the default.

    The ranges of a key do not overlap, so the one that may hold a position is the first to end at or after it: one
    sweep, no product of positions and ranges. Ranges without a key hold nothing; repeated rows all come back.
    """
    keyed = ranges.dropna(subset=by).select(*by, F.col(start).alias("_start"), F.col(end).alias("_end"), F.col(seg).alias("_seg"))
    swept = forward_asof(left, keyed, by, at, "_end", [F.col("_seg")])
    inside = F.when(F.col("version._start") <= F.col(at), F.col("version._seg"))
    return swept.withColumn("segment", F.coalesce(override, inside, default)).drop("version")


def overlaps(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """(by, left, right, a, b): the steps that a left and a right range (start, end) of one key share, ends included.

    The ranges of either side do not overlap among themselves, so the pieces lie between neighbouring starts: one sweep,
    no product of the two sides.
    """
    side = lambda df: F.struct(*[c for c in df.columns if c not in by])
    none = lambda df: F.lit(None).cast(df.select(side(df).alias("s")).schema["s"].dataType)
    ends = left.select(*by, F.col("start").alias("a"), side(left).alias("left"), none(right).alias("right")).union(right.select(*by, "start", none(left), side(right)))
    starts = ends.groupBy(*by, "a").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    w = Window.partitionBy(*by).orderBy("a")
    swept = starts.select(*by, "a", F.lead("a").over(w).alias("_next"), *[F.last(c, ignorenulls=True).over(w).alias(c) for c in ("left", "right")])
    until = F.least(F.col("left.end"), F.col("right.end"), F.col("_next") - 1)
    return swept.where("left is not null and right is not null").select(*by, "left", "right", "a", until.alias("b")).where("a <= b")


def straddling(anchors: DataFrame, by: list[str], anchor: str, boundary: Column) -> DataFrame:
    """Anchors whose interval (previous anchor, anchor] holds a boundary that is not its own first position."""
    previous = F.coalesce(F.lag(anchor).over(Window.partitionBy(*by).orderBy(anchor)), F.lit(0))
    return anchors.withColumn("previous", previous).withColumn("boundary", boundary).where((F.col("previous") + 1 < F.col("boundary")) & (F.col("boundary") <= F.col(anchor)))


def join_with_fix(left: DataFrame, right: DataFrame, key: str, value: str, fixes: DataFrame) -> DataFrame:
    """`value` from `right` by key, else as declared in `fixes`; `origin` tells which."""
    found = left.join(right.select(key, F.col(value).alias("_seen")), key, "left").join(fixes.select(key, F.col(value).alias("_fix")), key, "left")
    origin = F.when(F.col("_seen").isNotNull(), "seen").when(F.col("_fix").isNotNull(), "fix").otherwise("none")
    return found.withColumn(value, F.coalesce("_seen", "_fix")).withColumn("origin", origin).drop("_seen", "_fix")


def beyond_tolerance(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str, seconds: float) -> DataFrame:
    """Pairs whose times differ by more than `seconds`: a report, nothing is filtered from the join itself."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return left.join(right, keys).withColumn("off_s", F.abs(micros(a) - micros(b)) / F.lit(1e6)).where(F.col("off_s") > seconds)


def reconcile(declared: DataFrame, observed: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer difference: `missing` (declared only), `extra` (observed only), `differs`; equal rows are left out."""
    d = declared.select(*keys, F.col(value).alias("declared"), F.lit(True).alias("_d"))
    o = observed.select(*keys, F.col(value).alias("observed"), F.lit(True).alias("_o"))
    both = d.join(o, keys, "full_outer")
    verdict = F.when(F.col("_o").isNull(), "missing").when(F.col("_d").isNull(), "extra").when(~F.col("declared").eqNullSafe(F.col("observed")), "differs")
    return both.withColumn("verdict", verdict).where("verdict is not null").drop("_d", "_o")


def missing_cells(rows: DataFrame, entity: str, step: str, view: str, views: list[str]) -> DataFrame:
    """Expected (step from 0 to the entity's last, view) cells that are not there."""
    expected = rows.groupBy(entity).agg(F.max(step).alias("_n")).select(entity, F.explode(F.sequence(F.lit(0).cast("long"), "_n")).alias(step))
    expected = expected.withColumn(view, F.explode(F.array(*[F.lit(v) for v in views])))
    return expected.join(rows.select(entity, step, view), [entity, step, view], "left_anti")


def unique_of_class(instances: DataFrame, by: list[str], key: str) -> DataFrame:
    """The key of each class that has exactly one instance; other classes give no row."""
    return instances.groupBy(*by).agg(F.count("*").alias("_n"), F.min(key).alias(key)).where("_n = 1").drop("_n")


def band_candidates(left: DataFrame, right: DataFrame, by: list[str], at: str, other: str, width: int, rank: list[Column], limit: int) -> DataFrame:
    """Right rows of the same key within `width` positions, ranked and cut to `limit` for each left row.

    Positions are cut into bands of `width`; a right row is put into its own band and both neighbours, so the join is
    an equi-join on (key, band) followed by the exact test.
    """
    l = left.withColumn("_band", F.floor(F.col(at) / width))  # noqa: E741
    r = right.withColumn("_band", F.explode(F.array(*[F.floor(F.col(other) / width) + d for d in (-1, 0, 1)])))
    near = l.join(r, [*by, "_band"]).where(F.abs(F.col(at) - F.col(other)) <= width).drop("_band")
    w = Window.partitionBy(*left.columns).orderBy(*rank)
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)


def touching(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str, cell: int) -> DataFrame:
    """Pairs of one key whose boxes (x0, y0, x1, y1 behind the prefixes `a` and `b`) come near each other.

    Boxes are dealt to grid cells of `cell`; only those that share one are paired, in the first cell they share. All that
    overlap are among the pairs, so the exact test follows. A box without coordinates meets none.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    deal = lambda df, p: df.withColumn("_cx", F.explode(F.sequence(at(f"{p}x0"), at(f"{p}x1")))).withColumn("_cy", F.explode(F.sequence(at(f"{p}y0"), at(f"{p}y1"))))
    first = (F.col("_cx") == F.greatest(at(f"{a}x0"), at(f"{b}x0"))) & (F.col("_cy") == F.greatest(at(f"{a}y0"), at(f"{b}y0")))
    return deal(left, a).join(deal(right, b), [*by, "_cx", "_cy"]).where(first).drop("_cx", "_cy")


def explained(blobs: DataFrame, boxes: DataFrame, by: list[str], iou: Column, containment: Column, iou_min: float = 0.1, contain_min: float = 0.7, a: str = "a_", b: str = "b_", cell: int = 64) -> DataFrame:
    """`blobs` with whether any box of the same frame overlaps enough or contains enough of it; both limits are above 0."""
    hits = touching(blobs, boxes, by, a, b, cell).where((iou >= iou_min) | (containment >= contain_min))
    every = blobs.withColumn("explained", F.lit(False)).union(hits.select(*blobs.columns, F.lit(True)))
    return every.groupBy(*blobs.columns).agg(F.max("explained").alias("explained"))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows whose non-null reference names no parent: the integrity check that a lake has in place of foreign keys."""
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
