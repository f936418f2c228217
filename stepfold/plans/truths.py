"""Queries of compiled frames, confirmation and conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import truth as C
from stepfold.plans.registry import query
from stepfold.plans.rollups import BOXES_SQL, boxes
from stepfold.plans.tables import table

COMPILED_SQL = f"""{BOXES_SQL},
o AS (SELECT a.frame, a.vec_id, max((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) / ((a.x1 - a.x0) * (a.y1 - a.y0))) AS occlusion, count(*) AS covers
  FROM b a JOIN b ON a.frame = b.frame AND a.label % 2 = b.label % 2 AND b.vec_id > a.vec_id AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY 1, 2),
c AS (SELECT b.frame, b.vec_id, coalesce(occlusion, 0.0) AS occlusion, coalesce(covers, 0) AS covers, least(x1 - x0, y1 - y0) AS side FROM b LEFT JOIN o ON o.vec_id = b.vec_id),
v AS (SELECT *, CASE WHEN occlusion >= 0.95 THEN 'occluded_full' WHEN side < 6 THEN 'too_small' WHEN side < 12 THEN 'visible_tiny' WHEN occlusion >= 0.3 THEN 'occluded_partial' ELSE 'visible' END AS visibility FROM c)"""


def _compiled(spark, sf_dir):
    shapes = boxes(spark, sf_dir).withColumn("placement", F.when(F.col("label") % 2 == 0, "in_chassis").otherwise("on_bench")).withColumnRenamed("vec_id", "instance").withColumn("layer", F.col("instance"))
    return C.compiled_boxes(shapes, ["frame"], "layer", 32)


@query("compiled_boxes", f"WITH {COMPILED_SQL} SELECT frame, vec_id AS instance, round(occlusion, 9) AS occlusion, covers, visibility FROM v")
def compiled_boxes(spark, sf_dir):
    """Boxes of a frame stacked by number, those of either placement apart."""
    return _compiled(spark, sf_dir).select("frame", "instance", F.round("occlusion", 9).alias("occlusion"), "covers", "visibility")


@query("truth_rows", f"WITH {COMPILED_SQL} SELECT frame, vec_id AS instance, CASE WHEN vec_id % 9 = 0 THEN 'out_of_view' ELSE visibility END AS visibility, vec_id % 9 = 0 AS forced FROM v")
def truth_rows(spark, sf_dir):
    compiled = _compiled(spark, sf_dir)
    given = compiled.where("instance % 9 = 0").select("frame", "instance", F.lit("out_of_view").alias("visibility"))
    return C.row_values(compiled, given, ["frame", "instance"]).select("frame", "instance", "visibility", "forced")


@query("label_changes", """
WITH s AS (SELECT p_partkey AS k, p_type AS visibility, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS placement, p_size % 3 = 0 AS forced FROM part),
n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN 'X' ELSE p_type END AS visibility, CASE WHEN p_partkey % 3 = 0 THEN 'Y' ELSE p_brand END AS placement, p_size % 5 = 0 AS forced FROM part)
SELECT s.k, 'visibility' AS field, s.visibility AS old, n.visibility AS new FROM s JOIN n USING (k) WHERE (s.forced OR n.forced) AND s.visibility <> n.visibility
UNION ALL SELECT s.k, 'placement', s.placement, n.placement FROM s JOIN n USING (k) WHERE s.placement <> n.placement""")
def label_changes(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    stored = p.select(k.alias("k"), F.col("p_type").alias("visibility"), F.when(k % 4 != 0, F.col("p_brand")).alias("placement"), (F.col("p_size") % 3 == 0).alias("forced"))
    new = p.select(k.alias("k"), F.when(k % 2 == 0, "X").otherwise(F.col("p_type")).alias("visibility"), F.when(k % 3 == 0, "Y").otherwise(F.col("p_brand")).alias("placement"), (F.col("p_size") % 5 == 0).alias("forced"))
    return C.label_changes(stored, new, ["k"])


@query("resolved_conflicts", """
WITH c AS (SELECT o_orderkey AS cid, o_custkey AS k, o_totalprice AS old, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice + 10 END AS new, o_totalprice + 10 + o_orderkey % 3 AS cur,
  CASE o_orderkey % 4 WHEN 0 THEN 'keep_old' WHEN 1 THEN 'accept_new' WHEN 2 THEN 'edited' END AS resolution FROM orders),
r AS (SELECT *, CASE WHEN resolution = 'accept_new' THEN CASE WHEN coalesce(abs(cur - new) <= 1.5, false) THEN 'accepted' ELSE 'superseded' END WHEN resolution = 'keep_old' THEN 'kept' WHEN resolution = 'edited' THEN 'edited' ELSE 'open' END AS status FROM c)
SELECT cid, k, status, CASE WHEN status = 'accepted' THEN cur ELSE old END AS value, status = 'kept' AS pin, CASE WHEN status = 'superseded' THEN cur END AS requeued FROM r""")
def resolved_conflicts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cid, old = F.col("o_orderkey"), F.col("o_totalprice")
    conflicts = o.select(cid.alias("cid"), F.col("o_custkey").alias("k"), old.alias("old"), F.when(cid % 6 != 0, old + 10).alias("new"), cid.alias("row"))
    decided = o.select(cid.alias("cid"), F.when(cid % 4 == 0, "keep_old").when(cid % 4 == 1, "accept_new").when(cid % 4 == 2, "edited").alias("resolution"))
    current = o.select(F.col("o_custkey").alias("k"), cid.alias("row"), (old + 10 + cid % 3).alias("value"))
    return C.resolve_conflicts(conflicts, decided, current, ["k", "row"], 1.5).drop("row")


BLOCKERS_SQL = """
a AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 7 AS instance FROM lineitem WHERE l_quantity > 48),
p AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 7 AS instance FROM lineitem WHERE l_tax > 0.07),
z AS (SELECT DISTINCT l_orderkey AS f, l_partkey % 7 AS instance FROM lineitem WHERE l_discount > 0.09),
e AS (SELECT f, 'conflict' AS kind, instance, 1 AS r FROM a UNION ALL SELECT f, 'problem', instance, 2 FROM p UNION ALL SELECT f, 'frozen', instance, 3 FROM z)"""


def _blockers(spark, sf_dir, thorough):
    rows = lambda when: table(spark, sf_dir, "lineitem").where(when).select(F.col("l_orderkey").alias("f"), (F.col("l_partkey") % 7).alias("instance")).distinct()
    return C.blockers(rows("l_quantity > 48"), rows("l_tax > 0.07"), rows("l_discount > 0.09"), ["f"], thorough)


@query("first_blockers", f"WITH {BLOCKERS_SQL} SELECT f, kind, instance FROM (SELECT *, min(r) OVER (PARTITION BY f) AS m FROM e) WHERE r = m")
def first_blockers(spark, sf_dir):
    return _blockers(spark, sf_dir, True)


@query("all_blockers", f"WITH {BLOCKERS_SQL} SELECT f, kind, instance FROM e WHERE r < 3 OR NOT EXISTS (SELECT 1 FROM a WHERE a.f = e.f AND a.instance = e.instance)")
def all_blockers(spark, sf_dir):
    return _blockers(spark, sf_dir, False)


@query("confirmed_frames", """
SELECT o_orderkey AS f, CASE WHEN o_orderkey % 2 = 0 AND NOT x AND o_orderkey % 10 <> 0 THEN 'verified' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN x THEN 'refused' WHEN o_orderkey % 10 = 0 THEN 'moved' ELSE 'verified' END END AS outcome
FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48) AS x FROM orders)""")
def confirmed_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("digest"))
    asked = frames.where("f % 2 = 0").select("f", F.when(F.col("f") % 10 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    refused = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_orderkey").alias("f"))
    return C.confirm(frames, asked, refused, ["f"]).select("f", "status", "outcome")


@query("demoted_rows", "SELECT l_orderkey AS f, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' AND l_orderkey % 3 = 0 THEN 'auto' WHEN l_returnflag = 'A' THEN 'verified' ELSE 'auto' END AS status FROM lineitem")
def demoted_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("f"), "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "A", "verified").otherwise("auto").alias("status"))
    return C.demote(rows, rows.where("f % 3 = 0"), ["f"])


@query("chosen_keyframes", """
WITH n AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, l_quantity::BIGINT AS step, CASE l_returnflag WHEN 'A' THEN 'on_bench' ELSE 'in_chassis' END AS placement FROM lineitem),
q AS (SELECT p_partkey AS k, a.v AS anchor, b.v AS version, CASE p_size % 2 WHEN 0 THEN 'on_bench' ELSE 'in_chassis' END AS placement, p_size + a.v AS x0 FROM part, (VALUES (10), (25), (40)) a(v), (VALUES (1), (2)) b(v))
SELECT k, l_orderkey, l_linenumber, step, placement, (SELECT x0 FROM q WHERE q.k = n.k AND q.placement = n.placement AND q.anchor >= n.step ORDER BY anchor, version DESC LIMIT 1) AS x0 FROM n""")
def chosen_keyframes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    needs = lines.select(F.lit(1).alias("desktop"), F.lit("scan").alias("view"), F.col("l_partkey").alias("instance"), C.placement_of(F.lit(None).cast("string"), F.when(F.col("l_returnflag") == "A", "box").otherwise("mask")).alias("placement"), F.lit(0).alias("segment"), F.col("l_quantity").cast("long").alias("step"), "l_orderkey", "l_linenumber")
    anchors = F.explode(F.array(*[F.lit(a) for a in (10, 25, 40)]))
    keys = table(spark, sf_dir, "part").select("p_partkey", "p_size", anchors.alias("anchor")).select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    x0 = F.col("p_size") + F.col("anchor")
    keys = keys.select(F.lit(1).alias("desktop"), F.lit("scan").alias("view"), F.col("p_partkey").alias("instance"), F.when(F.col("p_size") % 2 == 0, "on_bench").otherwise("in_chassis").alias("placement"), F.lit(0).alias("segment"), F.col("anchor").cast("long").alias("anchor"), "version", x0.alias("x0"), x0.alias("y0"), (x0 + 5).alias("x1"), (x0 + 5).alias("y1"))
    return C.chosen_keyframes(needs, keys).select(F.col("instance").alias("k"), "l_orderkey", "l_linenumber", "step", "placement", "x0")
