"""Shapes of a label-tool export: percent coordinates to pixel boxes, results to provisional instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.session import vocabulary

# The geometry types of the tool's results.
GEOMETRY = ["polygon", "polygonlabels", "ellipse", "rectangle", "brush", "brushlabels"]


def pixel_box(kind: Column, value: Column, width: Column, height: Column) -> Column:
    """Pixel box (x0, y0, x1, y1, end exclusive) of a polygon, rectangle (turned about its corner) or ellipse given in
    percent, clipped to the frame; null where it encloses nothing or is of another type. Halves round to even."""
    px = lambda v: v / 100.0 * width
    py = lambda v: v / 100.0 * height
    turn = F.radians(F.coalesce(value["rotation"], F.lit(0.0)))
    cos, sin = F.cos(turn), F.sin(turn)
    w, h = px(value["width"]), py(value["height"])
    sides = [(F.lit(0.0), F.lit(0.0)), (w, F.lit(0.0)), (w, h), (F.lit(0.0), h)]
    corner_x, corner_y = [px(value["x"]) + a * cos - b * sin for a, b in sides], [py(value["y"]) + a * sin + b * cos for a, b in sides]
    rx, ry = F.greatest(F.lit(1.0), F.bround(px(value["radiusX"]))), F.greatest(F.lit(1.0), F.bround(py(value["radiusY"])))
    reach_x, reach_y = F.bround(F.hypot(rx * cos, ry * sin)), F.bround(F.hypot(rx * sin, ry * cos))
    mid_x, mid_y = F.bround(px(value["x"])), F.bround(py(value["y"]))
    polygon = kind.isin("polygon", "polygonlabels") & (F.size(value["points"]) >= 3)
    xs = F.when(polygon, F.transform(value["points"], lambda p: px(p[0]))).when(kind == "rectangle", F.array(*corner_x)).when(kind == "ellipse", F.array(mid_x - reach_x, mid_x + reach_x))
    ys = F.when(polygon, F.transform(value["points"], lambda p: py(p[1]))).when(kind == "rectangle", F.array(*corner_y)).when(kind == "ellipse", F.array(mid_y - reach_y, mid_y + reach_y))
    low = lambda v: F.greatest(F.lit(0), F.bround(F.array_min(v)).cast("long"))
    high = lambda v, most: F.least(most.cast("long"), F.bround(F.array_max(v)).cast("long") + 1)
    box = F.struct(low(xs).alias("x0"), low(ys).alias("y0"), high(xs, width).alias("x1"), high(ys, height).alias("y1"))
    given = F.array_min(xs).isNotNull() & F.array_min(ys).isNotNull()
    return F.when(given & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]), box)


def import_shapes(results: DataFrame, labels: DataFrame) -> DataFrame:
    """Geometry results (image, id, type, label, x, y, value, width, height) with `outcome`, `cls`, `box` and `key`.

    Labels are (label, cls, hint): one without a class is skipped on purpose, one with `hint` only points. The outcome is
    unlabeled, unknown, skipped, degenerate, hint or shape. A shape's key is `ls:label#n`, counted in its image by x, y
    and id; results of one image fit a task.
    """
    shapes = results.where(F.col("type").isin(GEOMETRY))
    known = labels.select("label", "cls", "hint", F.lit(True).alias("_known"))
    joined = shapes.join(vocabulary(known), "label", "left")
    joined = joined.withColumn("box", pixel_box(F.col("type"), F.col("value"), F.col("width"), F.col("height")))
    hint = F.coalesce(F.col("hint"), F.lit(False))
    outcome = (
        F.when(F.col("label").isNull(), "unlabeled")
        .when(F.col("_known").isNull(), "unknown")
        .when(F.col("cls").isNull() & ~hint, "skipped")
        .when(F.col("box").isNull(), "degenerate")
        .when(hint, "hint")
        .otherwise("shape")
    )
    placed = joined.withColumn("outcome", outcome)
    n = F.row_number().over(Window.partitionBy("image", "outcome", "label").orderBy("x", "y", "id")).cast("string")
    key = F.when(F.col("outcome") == "shape", F.concat(F.lit("ls:"), "label", F.lit("#"), n))
    return placed.select("image", "id", "label", "outcome", "cls", "box", key.alias("key"))
