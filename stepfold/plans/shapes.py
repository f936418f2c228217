"""Queries of boxes, run-length masks, detection merging and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.functions import geometry as G
from stepfold.operators import grouped, joins
from stepfold.plans.registry import query
from stepfold.plans.rollups import BOXES_SQL, boxes
from stepfold.plans.tables import table

IOU_SQL = """
i AS (SELECT a.frame, a.vec_id AS a, b.vec_id AS b, a.label AS la, b.label AS lb, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM b a JOIN b ON a.frame = b.frame)"""


def _pairs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    left = b.select("frame", *[F.col(c).alias(f"a_{c}") for c in ("vec_id", "label", "x0", "y0", "x1", "y1")])
    right = b.select("frame", *[F.col(c).alias(f"b_{c}") for c in ("vec_id", "label", "x0", "y0", "x1", "y1")])
    return joins.touching(left, right, ["frame"], "a_", "b_", 16)


@query("box_iou", f"WITH {BOXES_SQL}, {IOU_SQL} SELECT a, b, i / (aa + ab - i) AS iou, i / aa AS containment, aa + ab - 2 * i AS sym_diff FROM i WHERE a < b AND i > 0")
def box_iou(spark, sf_dir):
    a, b = G.box("a_"), G.box("b_")
    p = _pairs(spark, sf_dir).where("a_vec_id < b_vec_id").where(G.intersection(a, b) > 0)
    return p.select(F.col("a_vec_id").alias("a"), F.col("b_vec_id").alias("b"), G.iou(a, b).alias("iou"), G.containment(a, b).alias("containment"), G.sym_diff(a, b).alias("sym_diff"))


@query("explained_blobs", f"WITH {BOXES_SQL}, {IOU_SQL} SELECT a, coalesce(bool_or(i / (aa + ab - i) >= 0.1 OR i / aa >= 0.7) FILTER (lb = 0), false) AS explained FROM i WHERE la <> 0 GROUP BY a")
def explained_blobs(spark, sf_dir):
    b = boxes(spark, sf_dir)
    blobs = b.where("label <> 0").select("frame", *[F.col(c).alias(f"a_{c}") for c in ("vec_id", "x0", "y0", "x1", "y1")])
    known = b.where("label = 0").select("frame", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    out = joins.explained(blobs, known, ["frame"], G.iou(G.box("a_"), G.box("b_")), G.containment(G.box("a_"), G.box("b_")), cell=16)
    return out.select(F.col("a_vec_id").alias("a"), "explained")


@query("clipped_boxes", f"""
WITH {BOXES_SQL}, c AS (SELECT vec_id, least(greatest(x0, 0), 110) AS x0, least(greatest(y0, 0), 100) AS y0, least(greatest(x1, 0), 110) AS x1, least(greatest(y1, 0), 100) AS y1 FROM b)
SELECT vec_id, CASE WHEN x1 > x0 AND y1 > y0 THEN concat_ws(',', x0, y0, x1 - x0, y1 - y0) ELSE '' END AS xywh FROM c""")
def clipped_boxes(spark, sf_dir):
    return boxes(spark, sf_dir).select("vec_id", F.coalesce(F.array_join(G.xywh(G.clip(G.box(), 110, 100)), ","), F.lit("")).alias("xywh"))


@query("similarity_boxes", f"WITH {BOXES_SQL} SELECT vec_id, 2e0 * x0 + 3 AS x0, 2e0 * y0 - 1 AS y0, 2e0 * x1 + 3 AS x1, 2e0 * y1 - 1 AS y1 FROM b")
def similarity_boxes(spark, sf_dir):
    b = G.similarity(G.box(), F.lit(2.0), F.lit(0.0), F.lit(3.0), F.lit(-1.0))
    return boxes(spark, sf_dir).select("vec_id", *[b[e].alias(e) for e in b])


@query("tile_grid", """
WITH s AS (SELECT p_partkey, 600 + p_size * 40 AS w, 500 + p_size * 10 AS h FROM part),
x AS (SELECT DISTINCT p_partkey, least(v, greatest(w - 640, 0)) AS x FROM s, (SELECT unnest(range(0, 20)) * 512 AS v) WHERE v - 512 < greatest(w - 640, 0) OR v = 0),
y AS (SELECT DISTINCT p_partkey, least(v, greatest(h - 640, 0)) AS y FROM s, (SELECT unnest(range(0, 20)) * 512 AS v) WHERE v - 512 < greatest(h - 640, 0) OR v = 0)
SELECT p_partkey, x::INTEGER AS x, y::INTEGER AS y FROM x JOIN y USING (p_partkey)""")
def tile_grid(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    grid = G.tiles(600 + F.col("p_size") * 40, 500 + F.col("p_size") * 10, 640, 512)
    return rows.select("p_partkey", F.explode(grid).alias("t")).select("p_partkey", "t.x", "t.y")


RUNS_SQL = "r AS (SELECT p_partkey, p_size + 1 AS a, 1 + p_partkey % 30 AS b, 7 + p_size % 5 AS c, 1 + p_partkey % 11 AS d, 3000 - (p_size + 1) - (1 + p_partkey % 30) - (7 + p_size % 5) - (1 + p_partkey % 11) AS e FROM part)"


@query("rle_stats", f"""
WITH {RUNS_SQL}, f AS (SELECT *, a AS s1, a + b AS e1, a + b + c AS s2, a + b + c + d AS e2 FROM r)
SELECT p_partkey, b + d AS area, least(s1 // 50, s2 // 50) AS x0, CASE WHEN s1 // 50 <> (e1 - 1) // 50 OR s2 // 50 <> (e2 - 1) // 50 THEN 0 ELSE least(s1 % 50, s2 % 50) END AS y0,
  (e2 - 1) // 50 + 1 AS x1, CASE WHEN s1 // 50 <> (e1 - 1) // 50 OR s2 // 50 <> (e2 - 1) // 50 THEN 50 ELSE greatest((e1 - 1) % 50, (e2 - 1) % 50) + 1 END AS y1, (60 BETWEEN s1 AND e1 - 1) OR (60 BETWEEN s2 AND e2 - 1) AS has FROM f""")
def rle_stats(spark, sf_dir):
    """Masks of 50 x 60 with two runs, written as COCO text and read back."""
    a, b, c, d = F.col("p_size") + 1, 1 + F.col("p_partkey") % 30, 7 + F.col("p_size") % 5, 1 + F.col("p_partkey") % 11
    counts = F.array(*[x.cast("long") for x in (a, b, c, d, 3000 - a - b - c - d)])
    rows = table(spark, sf_dir, "part").select("p_partkey", G.rle_decode(G.rle_encode(counts)).alias("counts")).select("p_partkey", G.foreground(F.col("counts")).alias("runs"))
    h = F.lit(50).cast("long")
    rows = rows.select("p_partkey", G.rle_area(F.col("runs")).alias("area"), G.rle_bbox(F.col("runs"), h).alias("b"), G.rle_contains(F.col("runs"), F.lit(1), F.lit(10), F.lit(50)).alias("has"))
    return rows.select("p_partkey", "area", *[F.col(f"b.{e}").cast("long").alias(e) for e in ("x0", "y0", "x1", "y1")], "has")


def _scored(spark, sf_dir):
    return boxes(spark, sf_dir).withColumn("score", (F.col("vec_id") * 37 % 101) / 101.0).withColumn("cut", F.col("vec_id") % 7 == 0)


@query("nms_boxes")
def nms_boxes(spark, sf_dir):
    """Surviving boxes after the tile-edge rule and greedy suppression (iterative; tested against a plain loop)."""
    return grouped.nms(_scored(spark, sf_dir), ["frame"], "label", "score", "vec_id", 0.3, cut="cut").select("vec_id")


def _matches(spark, sf_dir):
    b = _scored(spark, sf_dir)
    preds, truths = b.where("vec_id % 3 = 0"), b.where("vec_id % 3 > 0")
    return preds, truths, grouped.greedy_match(preds, truths, ["frame"], "score", "vec_id", "vec_id", 0.2)


@query("greedy_matches")
def greedy_matches(spark, sf_dir):
    """One-to-one matches of every third box to the others (iterative; tested against a plain loop)."""
    return _matches(spark, sf_dir)[2]


AP_SQL = """
d AS (SELECT label, vec_id, (vec_id * 37 % 101) / 101.0 AS score, CAST(vec_id * 7 % 5 < 2 AS BIGINT) AS hit FROM embeddings),
c AS (SELECT *, sum(hit) OVER w AS tp, row_number() OVER w AS n FROM d WINDOW w AS (PARTITION BY label ORDER BY score DESC, vec_id)),
v AS (SELECT *, max(tp / n) OVER (PARTITION BY label ORDER BY score DESC, vec_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c)"""


@query("average_precision", f"WITH {AP_SQL} SELECT label, round(sum(CASE WHEN hit = 1 THEN env ELSE 0 END) / (sum(hit) + 5), 9) AS ap, sum(hit)::BIGINT AS hits FROM v GROUP BY label UNION ALL SELECT label + 100, 0.0, 0 FROM embeddings GROUP BY label")
def average_precision(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") * 37 % 101 / 101.0).alias("score"))
    hit = F.col("vec_id") * 7 % 5 < 2
    truths = rows.where(hit).groupBy("label").agg((F.count("*") + 5).alias("n_truth"))
    truths = truths.union(truths.select(F.col("label") + 100, "n_truth"))  # and as many classes without predictions
    out = grouped.average_precision(rows, ["label"], "score", "vec_id", hit, truths)
    return out.select("label", F.round("ap", 9).alias("ap"), "hits")


@query("bootstrap_interval")
def bootstrap_interval(spark, sf_dir):
    """95 % interval of the mean value of each event type (hash draws; tested for coverage and reruns)."""
    return grouped.bootstrap_ci(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], "event_id", "value", 200, 0)


@query("layer_order")
def layer_order(spark, sf_dir):
    """Bottom-up order of the boxes of a frame, where a larger box lies below one that it overlaps."""
    b = boxes(spark, sf_dir)
    p = _pairs(spark, sf_dir).where(G.intersection(G.box("a_"), G.box("b_")) > 0)
    bigger = (G.area(G.box("a_")) > G.area(G.box("b_"))) | ((G.area(G.box("a_")) == G.area(G.box("b_"))) & (F.col("a_vec_id") < F.col("b_vec_id")))
    above = p.where(bigger).select("frame", F.col("a_vec_id").alias("below"), F.col("b_vec_id").alias("above"))
    return grouped.layer_order(b.select("frame", "vec_id"), above, ["frame"], "vec_id", "vec_id")


def _needs(spark, sf_dir):
    """A hundred parts are a machine. Removing the n-th needs the (n - 2)-th or (n - 5)-th gone first; the last two but
    one wait for each other."""
    p, n = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("machine"), F.col("p_partkey").alias("action")), F.col("action") % 100
    loop = F.when(n == 97, F.array(F.col("action") + 1)).when(n == 98, F.array(F.col("action") - 1))
    alts = F.coalesce(loop, F.array_compact(F.array(F.when(n >= 2, F.col("action") - 2), F.when(n >= 5, F.col("action") - 5))))
    alts = F.when(F.size(alts) == 0, F.lit(None)).otherwise(alts)
    return p.withColumn("edge", F.when(alts.isNotNull(), F.lit("needs"))).select("machine", "action", "edge", F.explode_outer(alts).alias("alternative"))


@query("deadlocks")
def deadlocks(spark, sf_dir):
    """Actions that can never be done, with their cycle (a fixpoint; tested on graphs solved by hand)."""
    return grouped.deadlocks(_needs(spark, sf_dir), ["machine"])


@query("removal_plans")
def removal_plans(spark, sf_dir):
    """Plans to three goals of each machine, of which one cannot be reached."""
    needs = _needs(spark, sf_dir)
    goals = needs.where("action % 100 in (60, 95, 97)").select("machine", F.col("action").alias("goal")).distinct()
    return grouped.removal_plans(needs.join(goals, "machine"), ["machine"], "goal")


@query("padded_boxes", f"""
WITH {BOXES_SQL}, p AS (SELECT *, round((x1 - x0) * 0.25::DOUBLE)::BIGINT AS dx, round((y1 - y0) * 0.25::DOUBLE)::BIGINT AS dy FROM b)
SELECT vec_id, least(greatest(x0 - dx, 0), 150) AS x0, least(greatest(y0 - dy, 0), 140) AS y0, least(greatest(x1 + dx, 0), 150) AS x1, least(greatest(y1 + dy, 0), 140) AS y1 FROM p""")
def padded_boxes(spark, sf_dir):
    """Boxes with a margin of a quarter of either side, cut to the frame."""
    b = G.pad(G.box(), 0.25, 150, 140)
    return boxes(spark, sf_dir).select("vec_id", *[b[e].alias(e) for e in b])
