"""Annotation documents of one view: categories, images and annotations, written as a folder for each list.

Frames are (machine, step, width, height, step_type, review_status), compiled rows (machine, step, key, cls, status,
mask_box, mask_area, box), conflicts (machine, step). Boxes are structs x0, y0, x1, y1; a row with a mask has its box
and pixel count, a row without one may have a plain box.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.functions import runs as R
from stepfold.functions.geometry import rle_encode
from stepfold.operators.tasks import annotation_ids, verified
from stepfold.session import vocabulary

FRAME = ["machine", "step"]


def categories(spark: SparkSession, classes: list[tuple[str, str | None]]) -> DataFrame:
    """(id, name, supercategory) of a vocabulary: ids from 1 in its order, `other` for a class without a group."""
    rows = [(i, name, group or "other") for i, (name, group) in enumerate(classes, 1)]
    return spark.createDataFrame(rows, "id long, name string, supercategory string")


def refuse_conflicts(conflicts: DataFrame, allow: bool) -> DataFrame:
    """The disputed frames; an error where there are any and the caller does not allow them."""
    if not allow and (first := conflicts.select(*FRAME).first()) is not None:
        raise ValueError(f"open conflicts, one of them on machine {first[0]}, step {first[1]}: settle them or allow them")
    return conflicts.select(*FRAME).distinct().withColumn("disputed", F.lit(True))


def images(frames: DataFrame, rows: DataFrame, disputed: DataFrame, tier: str, only_verified: bool = True) -> DataFrame:
    """One row for each frame that has a compiled row to export, but for steps of type `ignore`.

    `verified` asks for the frame's own review status or for every row of it, the unexported ones too, and for no
    dispute. Extra columns of the frames pass through.
    """
    kept = rows.where(F.col("status") == "verified") if only_verified else rows
    shown = frames.where(F.coalesce(F.col("step_type"), F.lit("normal")) != "ignore").join(kept, FRAME, "left_semi")
    reviewed = shown.withColumn("_reviewed", F.coalesce(F.col("review_status") == "verified", F.lit(False)))
    sure = verified(reviewed, rows, FRAME, "_reviewed", "status").select(*FRAME, F.lit(True).alias("_sure")).distinct()
    marked = shown.join(sure, FRAME, "left").join(disputed, FRAME, "left")
    is_sure = F.coalesce(F.col("_sure"), F.lit(False)) & F.col("disputed").isNull()
    return marked.withColumn("tier", F.lit(tier)).withColumn("verified", is_sure).drop("_sure", "disputed")


def in_region(box: Column, region: Column) -> Column:
    """A box clipped to a region, in its coordinates; null where nothing is left. A null region is the whole frame."""
    cut = F.struct(
        (F.greatest(box["x0"], region["x0"]) - region["x0"]).alias("x0"),
        (F.greatest(box["y0"], region["y0"]) - region["y0"]).alias("y0"),
        (F.least(box["x1"], region["x1"]) - region["x0"]).alias("x1"),
        (F.least(box["y1"], region["y1"]) - region["y0"]).alias("y1"),
    )
    return F.when(region.isNull(), box).when((cut["x1"] > cut["x0"]) & (cut["y1"] > cut["y0"]), cut)


def masked(rows: DataFrame, images: DataFrame) -> DataFrame:
    """Compiled rows whose `runs` are their masks, with `mask_box`, `mask_area` and `segmentation` (size, counts as text)
    on the canvas of their image (width, height), cropped to its `region` if it has one. What is empty then is no mask."""
    sized = rows.join(images.select(*FRAME, "width", "height", F.col("region").alias("_region")), FRAME)
    size = lambda low, high, whole: F.coalesce(F.col(f"_region.{high}") - F.col(f"_region.{low}"), F.col(whole)).cast("long")
    cut = sized.withColumn("runs", R.cropped(F.col("runs"), F.col("_region"))).withColumn("_h", size("y0", "y1", "height")).withColumn("_w", size("x0", "x1", "width"))
    seen = F.size("runs") > 0
    text = rle_encode(R.counts(F.col("runs"), F.col("_h"), F.col("_w")))
    out = cut.withColumn("mask_box", R.bbox(F.col("runs"))).withColumn("mask_area", F.when(seen, R.area(F.col("runs"))))
    return out.withColumn("segmentation", F.when(seen, F.struct(F.array("_h", "_w").alias("size"), text.alias("counts")))).drop("_h", "_w", "_region", "width", "height", "runs")


def annotations(images: DataFrame, rows: DataFrame, disputed: DataFrame, classes: DataFrame, order: list[str], only_verified: bool = True, include_boxes: bool = False) -> DataFrame:
    """Annotations of the given images with dense ids in the given order, after all rows without geometry or class are gone.

    A mask row has its pixel count as area; a plain box comes along under `include_boxes` only, clipped to the `region` of
    its image, with its own area; masks come cropped, as `masked` gives them. A row of a disputed frame is not verified
    whatever its status says.
    """
    kept = rows.where(F.col("status") == "verified") if only_verified else rows
    named = classes.select(F.col("id").alias("category_id"), F.col("name").alias("cls"))
    joined = kept.join(images.select(*FRAME, "image_id", "region"), FRAME).join(vocabulary(named), "cls").join(disputed, FRAME, "left")
    plain = in_region(F.col("box"), F.col("region"))
    box = F.when(F.col("mask_box").isNotNull(), F.col("mask_box"))
    box = box.when(F.lit(include_boxes), plain)
    shaped = joined.withColumn("_box", box).where("_box is not null")
    b, masked = F.col("_box"), F.col("mask_box").isNotNull()
    area = F.when(masked, F.col("mask_area")).otherwise((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]))
    out = shaped.withColumn("area", area.cast("double")).withColumn("segmented", masked)
    out = out.withColumn("bbox", F.array(*[x.cast("double") for x in (b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])]))
    sure = F.col("disputed").isNull() & F.coalesce(F.col("status") == "verified", F.lit(False))
    return annotation_ids(out.withColumn("verified", sure).drop("disputed", "_box", "region", "box", "mask_box", "mask_area"), order)


def json_number(value: Column) -> Column:
    """A number as JSON writes it: whole ones without a fraction."""
    whole = value.cast("long")
    return F.when(value == whole, whole.cast("string")).otherwise(value.cast("string"))


def write_document(folder: str, classes: DataFrame, images: DataFrame, annotations: DataFrame) -> None:
    """The three lists of a document as JSON lines, gzipped, a folder for each, so that no task writes them all."""
    for name, rows in (("categories", classes.coalesce(1)), ("images", images), ("annotations", annotations)):
        rows.write.option("compression", "gzip").json(f"{folder}/{name}")
