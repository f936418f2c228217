"""Queries of annotation documents, progress records and import checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepfold.operators import documents, imports, tasks
from stepfold.plans.registry import ORACLES, query
from stepfold.plans.tables import table
from stepfold.session import cut, shared_folder
from stepfold.sources import shapes

CLASSES = [("ECONOMY", "plain"), ("LARGE", None), ("MEDIUM", None), ("PROMO", "plain"), ("SMALL", None)]
BINS = ["0-25", "25-50", "50-75", "75-100"]  # fixed values: the quarters of the work
ORDER = ["machine", "step", "key", "l_quantity", "l_tax", "l_discount", "l_extendedprice"]


def _frames(spark, sf_dir):
    """Orders as frames: the customer is the machine, part of them has a region, urgent ones are to be ignored."""
    o = table(spark, sf_dir, "orders")
    region = F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit(12.0).alias("x0"), F.lit(2.0).alias("y0"), F.lit(60.0).alias("x1"), F.lit(9.0).alias("y1")))
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "ignore").otherwise("normal")
    status = F.when(F.col("o_orderstatus") == "P", "verified")
    return o.select(F.col("o_custkey").alias("machine"), F.col("o_orderkey").alias("step"), F.col("o_orderkey").alias("image_id"), kind.alias("step_type"), status.alias("review_status"), region.alias("region"))


def _rows(spark, sf_dir):
    """Order lines as compiled rows: every second line has a mask, the others a plain box."""
    line = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "step").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("machine"), F.col("o_orderkey").alias("step")), "step")
    line = line.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("cls")), "l_partkey")
    x, y = F.col("l_linenumber") * 10.0, F.round(F.col("l_discount") * 100)
    box = F.struct(x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity")).alias("x1"), (y + 5.0).alias("y1"))
    masked = F.col("l_linenumber") % 2 == 0
    status = F.when(F.col("l_linestatus") == "F", "verified").otherwise("auto")
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    return line.select(*ORDER[:2], key.alias("key"), *ORDER[3:], "cls", status.alias("status"), F.when(masked, box).alias("mask_box"), F.when(masked, F.floor("l_quantity")).alias("mask_area"), F.when(~masked, box).alias("box"))


def _disputed(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 450000")
    return documents.refuse_conflicts(o.select(F.col("o_custkey").alias("machine"), F.col("o_orderkey").alias("step")), allow=True)


IMAGES_SQL = """
l AS (SELECT *, l_linestatus = 'F' AS sure FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
i AS (
  SELECT o_orderkey AS image_id, o_custkey AS machine, o_orderkey % 3 = 0 AS cropped, o_totalprice > 450000 AS disputed, (o_orderstatus = 'P' OR bool_and(sure)) AND NOT o_totalprice > 450000 AS verified
  FROM l WHERE o_orderpriority <> '1-URGENT' GROUP BY o_orderkey, o_custkey, o_totalprice, o_orderstatus HAVING bool_or(sure))"""


@query("document_images", f"WITH {IMAGES_SQL.strip()} SELECT image_id, machine, 'gold' AS tier, verified FROM i")
def document_images(spark, sf_dir):
    got = documents.images(_frames(spark, sf_dir), _rows(spark, sf_dir), _disputed(spark, sf_dir), "gold")
    return got.select("image_id", "machine", "tier", "verified")


@query(
    "document_annotations",
    f"""
WITH {IMAGES_SQL.strip()},
b AS (
  SELECT i.*, l.*, list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL'], p_type)::BIGINT AS category_id, l_linenumber % 2 = 0 AS segmented, l_linenumber * 10.0::DOUBLE AS x, round(l_discount * 100) AS y,
    concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS key
  FROM l JOIN i ON i.image_id = l_orderkey WHERE sure AND p_type <> 'STANDARD'),
c AS (
  SELECT *, CASE WHEN segmented OR NOT cropped THEN x ELSE greatest(x, 12) - 12 END AS x0, CASE WHEN segmented OR NOT cropped THEN y ELSE greatest(y, 2) - 2 END AS y0,
    CASE WHEN segmented OR NOT cropped THEN x + l_quantity ELSE least(x + l_quantity, 60) - 12 END AS x1, CASE WHEN segmented OR NOT cropped THEN y + 5 ELSE least(y + 5, 9) - 2 END AS y1 FROM b)
SELECT row_number() OVER (ORDER BY machine, image_id, key, l_quantity, l_tax, l_discount, l_extendedprice) AS id, image_id, category_id, segmented, x0 AS bbox_x, y0 AS bbox_y, x1 - x0 AS bbox_w, y1 - y0 AS bbox_h,
  CASE WHEN segmented THEN floor(l_quantity) ELSE (x1 - x0) * (y1 - y0) END AS area, NOT disputed AS verified
FROM c WHERE segmented OR (x1 > x0 AND y1 > y0)""",
)
def document_annotations(spark, sf_dir):
    """Verified rows with masks or boxes, clipped to the region of their image, with dense ids."""
    return _shown(_document(spark, sf_dir)[2])


def _document(spark, sf_dir):
    rows, disputed, classes = _rows(spark, sf_dir), _disputed(spark, sf_dir), documents.categories(spark, CLASSES)
    shown = cut(documents.images(_frames(spark, sf_dir), rows, disputed, "gold"))  # written, and asked by the annotations
    return classes, shown, documents.annotations(shown, rows, disputed, classes, ORDER, include_boxes=True)


def _shown(got):
    return got.select("id", "image_id", "category_id", "segmented", *[F.col("bbox")[k].alias(f"bbox_{c}") for k, c in enumerate("xywh")], "area", "verified")


@query("reread_annotations", ORACLES["document_annotations"])
def reread_annotations(spark, sf_dir):
    """The annotations of a document that was written as JSON lines and is read again; those whose image or category is
    not in the document are left out, so the rows agree only if all three lists do."""
    classes, images, got = _document(spark, sf_dir)
    folder = f"{shared_folder(spark)}/document-{uuid.uuid4().hex}"
    documents.write_document(folder, classes, images, got)
    read = lambda name, df: spark.read.schema(df.schema).json(f"{folder}/{name}")
    whole = read("annotations", got).join(read("images", images).select("image_id"), "image_id", "left_semi")
    return _shown(whole.join(read("categories", classes).select(F.col("id").alias("category_id")), "category_id", "left_semi"))


@query(
    "progress_records",
    """
WITH e AS (SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS day, event_type AS verb, CASE WHEN user_id % 5 = 0 AND event_type = 'error' THEN '?' ELSE 'k' || event_id % 7 END AS target FROM events),
a AS (SELECT * FROM e WHERE verb <> 'view' AND user_id NOT IN (SELECT user_id FROM e WHERE target = '?')),
f AS (SELECT DISTINCT user_id, day FROM e),
d AS (SELECT f.user_id, f.day, string_agg(DISTINCT verb || ' ' || target, ',' ORDER BY verb || ' ' || target) AS done, count(*) AS n FROM f JOIN a ON a.user_id = f.user_id AND a.day <= f.day GROUP BY ALL),
t AS (SELECT user_id, count(*) AS total FROM a GROUP BY ALL)
SELECT f.user_id, CAST(f.day AS BIGINT) AS day, coalesce(done, '') AS done, total - coalesce(n, 0) AS remaining, ['0-25', '25-50', '50-75', '75-100'][CAST(least(floor(coalesce(n, 0) / total * 4), 3) AS INTEGER) + 1] AS bin
FROM f JOIN t USING (user_id) LEFT JOIN d USING (user_id, day)""",
)
def progress_records(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("day"), F.col("event_type").alias("verb"), "event_id")
    unnamed = (F.col("user_id") % 5 == 0) & (F.col("verb") == "error")
    e = e.withColumn("target", F.when(unnamed, "?").otherwise(F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))))
    got = tasks.progress_records(e, e.where("verb <> 'view'"), "user_id", "day", BINS)
    return got.withColumn("done", F.array_join(F.transform("done", lambda d: F.concat_ws(" ", d["verb"], d["target"])), ","))


@query(
    "log_sequence_issues",
    """
WITH e AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step,
    CASE event_id % 11 WHEN 3 THEN NULL WHEN 4 THEN ' ' WHEN 5 THEN 'x' || event_id WHEN 6 THEN '2.0' ELSE CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2 - event_id % 2 AS VARCHAR) END AS number FROM events),
v AS (SELECT *, trim(coalesce(number, '')) AS said, CAST(TRY_CAST(number AS DOUBLE) AS BIGINT) AS v FROM e),
w AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(step) OVER (PARTITION BY user_id, v) AS first FROM v)
SELECT user_id, step, CASE WHEN said = '' THEN 'blank' WHEN v IS NULL THEN 'not a number' WHEN first < step THEN 'repeats step ' || first
  WHEN v = b + 2 THEN 'skips ' || (b + 1) ELSE 'skips ' || (b + 1) || '-' || (v - 1) END AS issue
FROM w WHERE said = '' OR v IS NULL OR first < step OR v > b + 1""",
)
def log_sequence_issues(spark, sf_dir):
    e = _numbered(spark, sf_dir)
    odd = F.col("event_id") % 11
    number = F.when(odd == 3, None).when(odd == 4, " ").when(odd == 5, F.concat(F.lit("x"), F.col("event_id").cast("string"))).when(odd == 6, "2.0").otherwise((F.col("step") * 2 - F.col("event_id") % 2).cast("string"))
    return imports.sequence_issues(e.withColumn("number", number), "user_id", "step", "number")


def _numbered(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("step", F.row_number().over(order).cast("long"))


@query(
    "log_repeated_operations",
    """
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type AS verb, event_id % 4 AS key, value > 5 AS ok FROM events)
SELECT * FROM (SELECT user_id, key, verb, step, lag(step) OVER (PARTITION BY user_id, key, verb ORDER BY step) AS before FROM e WHERE ok) WHERE before IS NOT NULL""",
)
def log_repeated_operations(spark, sf_dir):
    result = F.when(F.col("value") > 5, "success").otherwise("failed")
    e = _numbered(spark, sf_dir).select("user_id", "step", F.col("event_type").alias("verb"), (F.col("event_id") % 4).alias("key"), result.alias("result"))
    return imports.repeated_operations(e, ["user_id", "key", "verb"], "step")


@query(
    "label_shapes",
    """
WITH r AS (
  SELECT l_orderkey AS image, concat_ws('-', l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, CASE WHEN l_linenumber < 7 THEN p_type END AS label,
    l_discount * 1000 AS x, l_tax * 1000 AS y, l_quantity AS w, l_quantity / 2 AS h FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (
  SELECT *, greatest(0, round_even(x / 100.0::DOUBLE * 4032, 0)::BIGINT) AS x0, greatest(0, round_even(y / 100.0::DOUBLE * 3040, 0)::BIGINT) AS y0,
    least(4032, round_even(x / 100.0::DOUBLE * 4032 + w / 100.0::DOUBLE * 4032, 0)::BIGINT + 1) AS x1, least(3040, round_even(y / 100.0::DOUBLE * 3040 + h / 100.0::DOUBLE * 3040, 0)::BIGINT + 1) AS y1 FROM r),
o AS (
  SELECT *, CASE WHEN label IS NULL THEN 'unlabeled' WHEN label = 'STANDARD' THEN 'unknown' WHEN label = 'LARGE' THEN 'skipped' WHEN x1 <= x0 OR y1 <= y0 THEN 'degenerate' WHEN label = 'PROMO' THEN 'hint' ELSE 'shape' END AS outcome FROM b)
SELECT image, id, label, outcome, CASE WHEN x1 > x0 AND y1 > y0 THEN concat_ws(' ', x0, y0, x1, y1) END AS box,
  CASE WHEN outcome = 'shape' THEN 'ls:' || label || '#' || row_number() OVER (PARTITION BY image, outcome, label ORDER BY x, y, id) END AS key FROM o""",
)
def label_shapes(spark, sf_dir):
    """Order lines as rectangles of an export, part types as labels."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    line = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    x, y = F.col("l_discount") * 1000, F.col("l_tax") * 1000
    none = F.lit(None).cast("double")
    value = F.struct(
        x.alias("x"), y.alias("y"), F.col("l_quantity").alias("width"), (F.col("l_quantity") / 2).alias("height"), none.alias("rotation"), none.alias("radiusX"), none.alias("radiusY"),
        F.lit(None).cast("array<array<double>>").alias("points"),
    )
    results = line.select(
        F.col("l_orderkey").alias("image"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("id"), F.lit("rectangle").alias("type"),
        F.when(F.col("l_linenumber") < 7, F.col("p_type")).alias("label"), x.alias("x"), y.alias("y"), value.alias("value"), F.lit(4032).alias("width"), F.lit(3040).alias("height"),
    )
    labels = spark.createDataFrame([("ECONOMY", "a", False), ("LARGE", None, False), ("MEDIUM", "b", False), ("PROMO", None, True), ("SMALL", "c", None)], "label string, cls string, hint boolean")
    box = F.when(F.col("box").isNotNull(), F.concat_ws(" ", "box.x0", "box.y0", "box.x1", "box.y1"))
    return shapes.import_shapes(results, labels).select("image", "id", "label", "outcome", box.alias("box"), "key")
