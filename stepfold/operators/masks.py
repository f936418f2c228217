"""Shapes to runs of pixels, and the stacking of masks in a frame, column by column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.functions import runs as R
from stepfold.functions.text import visibility


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, runs): the rows (x, y0, y1) of each mask as one sorted array."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("x").cast("bigint").alias("x"), F.col("y0").cast("bigint").alias("y0"), F.col("y1").cast("bigint").alias("y1")))).alias("runs"))


def scattered(masks: DataFrame, keys: list[str], runs: str = "runs") -> DataFrame:
    """(keys, x, y0, y1): one row a run."""
    return masks.select(*keys, F.explode(runs).alias("_r")).select(*keys, "_r.x", "_r.y0", "_r.y1")


def polygon_runs(rings: DataFrame, keys: list[str], ring: str, points: str, height: Column, width: Column) -> DataFrame:
    """(keys, x, y0, y1): pixels of the rings (array of struct<x, y>, whole numbers) of each mask, clipped to the canvas.

    The rings of a mask come together in one row, as `runs.polygons` takes them; a ring of fewer than three points is
    nothing.
    """
    each = rings.where(F.size(points) >= 3).select(*keys, R.ring(F.col(ring), F.col(points), height, width).alias("_r"))
    masks = each.groupBy(*keys).agg(F.collect_list("_r").alias("_r"))
    return scattered(masks.select(*keys, R.polygons(F.col("_r")).alias("runs")), keys)


def ellipse_runs(ellipses: DataFrame, keys: list[str], height: Column, width: Column) -> DataFrame:
    """(keys, x, y0, y1): pixels whose centre is in the ellipse (cx, cy, rx, ry, turn in degrees), one solved quadratic
    a column; radii are one pixel at least."""
    t, rx, ry = F.radians(F.coalesce("turn", F.lit(0.0))), F.greatest("rx", F.lit(1)).cast("double"), F.greatest("ry", F.lit(1)).cast("double")
    cos, sin = F.cos(t), F.sin(t)
    reach = F.sqrt(rx * rx * cos * cos + ry * ry * sin * sin)
    e = ellipses.select(*keys, height.cast("bigint").alias("_h"), F.col("cx").cast("double").alias("cx"), F.col("cy").cast("double").alias("cy"), (sin * sin / (rx * rx) + cos * cos / (ry * ry)).alias("_a"), (cos * sin * (1 / (rx * rx) - 1 / (ry * ry))).alias("_b"), (cos * cos / (rx * rx) + sin * sin / (ry * ry)).alias("_c"), F.greatest(F.ceil(F.col("cx") - reach), F.lit(0)).alias("_from"), F.least(F.floor(F.col("cx") + reach), width.cast("bigint") - 1).alias("_to"))
    x = e.where("_to >= _from").withColumn("x", F.explode(F.sequence("_from", "_to")))
    dx = F.col("x") - F.col("cx")
    inner = F.pow(F.col("_b") * dx, 2) - F.col("_a") * (F.col("_c") * dx * dx - 1)
    half = F.sqrt(F.greatest(inner, F.lit(0.0))) / F.col("_a")
    mid = F.col("cy") - F.col("_b") * dx / F.col("_a")
    # an end that misses a whole number by rounding alone still counts
    y0, y1 = F.ceil(mid - half - 1e-9), F.floor(mid + half + 1e-9) + 1
    return x.where(inner >= -1e-12).select(*keys, "x", F.greatest(y0, F.lit(0)).alias("y0"), F.least(y1, F.col("_h")).alias("y1")).where("y1 > y0")


def label_tool_runs(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y0, y1) of a label tool's results (keys, type, value, width, height), percent coordinates.

    Polygons, rectangles turned about their corner, and ellipses; points are rounded, halves to even. Results of other
    types, and with missing numbers, have no pixels.
    """
    v, w, h = F.col("value"), F.col("width"), F.col("height")
    px, py = (lambda n: n / 100.0 * w), (lambda n: n / 100.0 * h)
    turn = F.radians(F.coalesce(v["rotation"], F.lit(0.0)))
    point = lambda x, y: F.struct(F.bround(x).cast("bigint").alias("x"), F.bround(y).cast("bigint").alias("y"))
    sides = [(F.lit(0.0), F.lit(0.0)), (px(v["width"]), F.lit(0.0)), (px(v["width"]), py(v["height"])), (F.lit(0.0), py(v["height"]))]
    corners = F.array(*[point(px(v["x"]) + a * F.cos(turn) - b * F.sin(turn), py(v["y"]) + a * F.sin(turn) + b * F.cos(turn)) for a, b in sides])
    given = F.transform(v["points"], lambda p: point(px(p[0]), py(p[1])))
    points = F.when(F.col("type").isin("polygon", "polygonlabels"), given).when(F.col("type") == "rectangle", corners)
    rings = results.select(*keys, F.lit(0).alias("_k"), points.alias("_p"), w.alias("_width"), h.alias("_height")).where(F.col("_p").isNotNull() & ~F.exists("_p", lambda p: p["x"].isNull() | p["y"].isNull()))
    turned = polygon_runs(rings, keys, "_k", "_p", F.col("_height"), F.col("_width"))
    round_ = results.where("type = 'ellipse'").select(*keys, F.bround(px(v["x"])).alias("cx"), F.bround(py(v["y"])).alias("cy"), F.bround(px(v["radiusX"])).alias("rx"), F.bround(py(v["radiusY"])).alias("ry"), v["rotation"].alias("turn"), w.alias("_width"), h.alias("_height"))
    return turned.unionByName(ellipse_runs(round_, keys, F.col("_height"), F.col("_width")))


STRIP = 16  #: columns of a frame that are dealt to one task together


def stacked(layers: DataFrame, frame: list[str], occluders: DataFrame | None = None) -> DataFrame:
    """(frame, placement, instance, runs, amodal_px, visible_px): parts of what is seen of each instance, sorted, with the
    numbers of its own pixels and of those seen; an instance may have several rows, for different columns.

    layers: (frame, placement, instance, layer, x, y0, y1); an instance may have several, and the same layer twice. In
    each placement the highest layer is seen; of equal ones the greater instance. Occluders (frame, x, y0, y1) hide
    every placement. Each column of a frame is decided on its own, and a crowded frame is spread over its strips of
    columns; rows are shuffled and sorted by column once, and a kernel holds a batch and one column at a time.
    """
    key, column = [*frame, "placement", "instance"], [*frame, "x"]
    tell = [*key, "x"]
    rows = layers.select(*tell, "layer", F.lit(False).alias("front"), "y0", "y1").where(F.col("placement").isNotNull())
    if occluders is not None:
        none = [F.lit(None).cast(layers.schema[c].dataType).alias(c) for c in ("placement", "instance", "layer")]
        rows = rows.unionByName(occluders.select(*column, *none, F.lit(True).alias("front"), "y0", "y1"))
    whole = rows.withColumns({c: F.col(c).cast("bigint") for c in ("y0", "y1")}).where("y1 > y0").dropna(subset=column)
    placed = whole.repartition(*frame, F.floor(F.col("x") / STRIP)).sortWithinPartitions(*column, "front", "layer", "instance")

    def codes(rows: pa.RecordBatch, name: str) -> np.ndarray:
        return rows.column(name).dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)

    def group(rows: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        for name in column:
            new[1:] |= np.diff(codes(rows, name)) != 0
        return np.cumsum(new)

    def decided(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.concat_batches(held)
        front, y0, y1 = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("front", "y0", "y1"))
        item = np.where(R.there(rows.column("instance")), codes(rows, "instance"), -1)
        row, y0, y1, seen = R.stacked(group(rows), codes(rows, "placement"), front, item, y0, y1)
        of = np.zeros(len(row), np.int64)
        for name in key:
            at = codes(rows, name)
            of = np.unique(of * (at.max(initial=0) + 1) + at[row], return_inverse=True)[1]
        x = rows.column("x").cast(pa.int64()).to_numpy()[row]
        order = np.lexsort((y0, x, of))
        row, of, x, y0, y1, seen = (c[order] for c in (row, of, x, y0, y1, seen))
        first, px = np.flatnonzero(np.diff(of, prepend=-1)), y1 - y0
        n = [np.bincount(of, weights, len(first)).astype(np.int64) for weights in (px, px * seen, seen)]
        runs = pa.StructArray.from_arrays([pa.array(c[seen]) for c in (x, y0, y1)], ["x", "y0", "y1"])
        runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n[2])]).astype(np.int32)), runs)
        told = [rows.column(c).take(pa.array(row[first])) for c in key]
        return pa.RecordBatch.from_arrays([*told, runs, pa.array(n[0]), pa.array(n[1])], names=[*key, "runs", "amodal_px", "visible_px"])

    def run(batches):
        held = []
        for b in batches:
            if not b.num_rows:
                continue
            last = group(b)
            whole = int(np.searchsorted(last, last[-1]))  # the last column may go on in the next batch
            if whole:
                yield decided([*held, b.slice(0, whole)])
                held = []
            held.append(b.slice(whole))
        if held:
            yield decided(held)

    kinds = [f"`{c}` {placed.schema[c].dataType.simpleString()}" for c in key]
    return placed.mapInArrow(run, ", ".join([*kinds, f"runs {R.RUNS}", "amodal_px bigint", "visible_px bigint"]))


def compiled_runs(layers: DataFrame, frame: list[str], occluders: DataFrame | None = None) -> DataFrame:
    """(frame, placement, instance, runs, amodal_px, visible_px, occlusion, visibility) of the instances of each frame.

    runs is what is seen, an empty array if nothing is; occlusion the hidden share of the instance's own pixels;
    visibility the label that the shorter side of what is seen and the occlusion give. Instances without a pixel are
    not in the result: their shape is missing.
    """
    key = [*frame, "placement", "instance"]
    runs = F.array_sort(F.flatten(F.collect_list("runs")))
    out = stacked(layers, frame, occluders).groupBy(*key).agg(runs.alias("runs"), *[F.sum(c).alias(c) for c in ("amodal_px", "visible_px")])
    box = R.bbox(F.col("runs"))
    side = F.coalesce(F.least(box["x1"] - box["x0"], box["y1"] - box["y0"]), F.lit(0))
    out = out.withColumn("occlusion", 1 - F.col("visible_px") / F.col("amodal_px"))
    return out.withColumn("visibility", visibility(side, F.col("occlusion"))).select(*key, "runs", "amodal_px", "visible_px", "occlusion", "visibility")
