"""Queries of the pose re-cut: each part a view of 48 steps in four segments, the lines its shapes, cut at other places."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import recut as R
from stepfold.plans.registry import query
from stepfold.plans.tables import table

CUT_SQL = """
old AS (SELECT p_partkey AS m, i AS seg, i * 12 - 11 AS s, i * 12 AS e, CASE WHEN (p_partkey + i) % 6 > 0 THEN i * 12 - 11 + (p_size + i) % 12 END AS ref,
  CASE WHEN (p_partkey + i) % 3 = 0 THEN 'c' || i END AS corners, CASE WHEN (p_partkey + i) % 4 > 1 THEN 'r' || i END AS roi FROM part, range(1, 5) g(i)),
b AS (SELECT p_partkey AS m, unnest(CASE WHEN p_partkey % 5 = 0 THEN [13, 25, 37] WHEN p_partkey % 2 = 0 THEN [7, 13, 25, 30] ELSE [7, 25, 41] END) AS s FROM part),
st AS (SELECT m, s, s = 7 OR s = 13 AS small FROM b UNION ALL SELECT p_partkey, 1, false FROM part),
new AS (SELECT m, row_number() OVER w AS seg, s, coalesce(lead(s) OVER w - 1, 48) AS e, small FROM st WINDOW w AS (PARTITION BY m ORDER BY s)),
bad AS (SELECT m FROM old GROUP BY m HAVING bool_or(ref IS NULL)),
act AS (SELECT p_partkey AS m FROM part WHERE p_partkey % 5 <> 0 OR p_partkey IN (FROM bad)),
p AS (SELECT n.m, o.seg AS o, o.s AS os, o.e AS oe, n.seg, n.s, n.e, n.small, greatest(n.s, o.s) AS a, least(n.e, o.e) AS z, o.ref, o.corners, o.roi FROM old o JOIN new n ON o.m = n.m AND o.s <= n.e AND n.s <= o.e WHERE o.m IN (FROM act)),
q AS (SELECT *, coalesce(ref BETWEEN s AND e, false) AS h FROM p),
near AS (SELECT x.m, x.o, x.seg, bool_and(y.small OR y.seg <= least(x.seg, hm.g) OR y.seg > greatest(x.seg, hm.g)) AS ok FROM q x
  JOIN (SELECT m, o, coalesce(max(seg) FILTER (h), max(seg)) AS g FROM q GROUP BY m, o) hm USING (m, o) JOIN q y ON y.m = x.m AND y.o = x.o GROUP BY 1, 2, 3),
k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY m, seg ORDER BY CASE WHEN h AND corners IS NOT NULL THEN 2 WHEN h THEN 1 ELSE 0 END DESC, CASE WHEN h THEN ref ELSE a END DESC) = 1),
f AS (SELECT m, seg, arg_max(roi, (coalesce(ref, 0), o)) FILTER (roi IS NOT NULL) AS roi FROM q GROUP BY m, seg),
cut AS (SELECT k.m, k.seg, k.s, k.e, CASE WHEN k.h THEN k.ref ELSE k.e END AS ref, CASE WHEN k.h THEN k.corners END AS corners, CASE WHEN n.ok THEN coalesce(k.roi, f.roi) END AS roi, k.o AS keeper, NOT k.h AND k.corners IS NOT NULL AS dropped
  FROM k JOIN near n ON n.m = k.m AND n.o = k.o AND n.seg = k.seg JOIN f ON f.m = k.m AND f.seg = k.seg),
kf AS (SELECT l_partkey AS m, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT) AS id, l_linenumber % 2 AS inst, CASE WHEN l_suppkey % 9 = 0 THEN 0 ELSE (l_quantity::BIGINT + 11) // 12 END AS seg, l_quantity::BIGINT AS anchor, CASE WHEN l_suppkey % 4 = 0 THEN 'carried' ELSE 'human' END AS source, 1 + (l_orderkey % 3 = 0)::BIGINT AS version FROM lineitem)"""


def _done(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("m"), "p_size")
    i = F.col("seg")
    old = p.withColumn("seg", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long")))).select(
        "m", "seg", (i * 12 - 11).alias("start"), (i * 12).alias("end"), F.when((F.col("m") + i) % 6 > 0, i * 12 - 11 + (F.col("p_size") + i) % 12).alias("ref"),
        F.when((F.col("m") + i) % 3 == 0, F.concat(F.lit("c"), "seg")).alias("corners"), F.lit(None).cast("string").alias("homography"),
        F.when((F.col("m") + i) % 4 > 1, F.concat(F.lit("r"), "seg")).alias("roi"), F.lit(None).cast("string").alias("bench_roi"))
    at = F.when(F.col("m") % 5 == 0, F.array(*map(F.lit, (13, 25, 37)))).when(F.col("m") % 2 == 0, F.array(*map(F.lit, (7, 13, 25, 30)))).otherwise(F.array(*map(F.lit, (7, 25, 41))))
    bounds = p.select("m", F.explode(at.cast("array<bigint>")).alias("step")).withColumn("small", F.col("step").isin(7, 13))
    lines = table(spark, sf_dir, "lineitem").withColumn("anchor", F.col("l_quantity").cast("long")).withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "anchor"))
    shapes = lines.select(
        F.col("l_partkey").alias("m"), "id", (F.col("l_linenumber") % 2).alias("inst"), F.when(F.col("l_suppkey") % 9 == 0, 0).otherwise(F.floor((F.col("anchor") + 11) / 12)).cast("long").alias("seg"), "anchor",
        F.when(F.col("l_suppkey") % 4 == 0, R.CARRIED).otherwise("human").alias("source"), (1 + (F.col("l_orderkey") % 3 == 0).cast("long")).alias("version"), F.lit(0).cast("long").alias("edits"))
    parts = lines.select("id", F.lit(0).alias("idx"), F.col("l_returnflag").alias("name"))
    of = lines.select(F.col("l_partkey").alias("m"), F.floor((F.col("anchor") + 11) / 12).alias("seg"), F.concat(F.lit("k"), (F.col("l_suppkey") % 7).cast("string")).alias("e"), F.col("l_orderkey").alias("i"))
    layers = F.transform(F.array_sort(F.collect_list(F.struct("i", "e"))), lambda x: x["e"])
    orders = of.groupBy("m", "seg", "e").agg(F.min("i").alias("i")).groupBy("m", "seg").agg(layers.alias("layers")).withColumn("version", F.col("seg"))
    pairs = of.select("m", "seg", F.lit("k0").alias("above"), F.col("e").alias("below")).distinct()
    frames = lines.select(F.col("l_partkey").alias("m"), F.col("anchor").alias("step"), F.when(F.col("l_linenumber") < 4, F.col("l_linenumber").cast("long")).alias("seg")).distinct()
    frozen = lines.select(F.col("l_partkey").alias("m"), F.col("anchor").alias("step")).distinct()
    return R.recut(old, bounds, ["m"], keyframes=shapes, parts=parts, orders=orders, pairs=pairs, frames=frames, frozen=frozen, carry=bounds.where("step <> 30"), chain=["inst"])


@query("recut_segments", f"""WITH {CUT_SQL} SELECT m, seg, s AS "start", e AS "end", ref, corners, roi FROM cut
UNION ALL SELECT m, seg, s, e, ref, corners, roi FROM old WHERE m NOT IN (FROM act)""")
def recut_segments(spark, sf_dir):
    """The segments of every view after it was cut anew."""
    return _done(spark, sf_dir)["segments"].drop("homography", "bench_roi")


@query("recut_keyframes", f"""WITH {CUT_SQL},
fresh AS (SELECT m, s, seg FROM new WHERE m IN (FROM act) AND s NOT IN (1, 13, 25, 37)),
gone AS (SELECT o.m, o.s FROM old o WHERE o.m IN (FROM act) AND o.s > 1 AND NOT EXISTS (SELECT 1 FROM new n WHERE n.m = o.m AND n.s = o.s)),
kept AS (SELECT * FROM kf WHERE NOT (source = 'carried' AND version = 1 AND EXISTS (SELECT 1 FROM gone g WHERE g.m = kf.m AND g.s = kf.anchor + 1))),
moved AS (SELECT kept.m, id, CASE WHEN kept.seg BETWEEN 1 AND 4 AND kept.m IN (FROM act) THEN coalesce(n.seg, hm.seg) ELSE kept.seg END AS seg, anchor, source, version FROM kept
  LEFT JOIN new n ON n.m = kept.m AND kept.anchor BETWEEN n.s AND n.e LEFT JOIN new hm ON hm.m = kept.m AND kept.seg * 12 - 11 BETWEEN hm.s AND hm.e),
low AS (SELECT *, coalesce(max(anchor) OVER (PARTITION BY m, inst, seg ORDER BY anchor RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, seg * 12 - 11) AS low FROM kf WHERE seg BETWEEN 1 AND 4)
SELECT * FROM moved UNION ALL SELECT low.m, id || '@' || (f.s - 1), f.seg - 1, f.s - 1, 'carried', 1 FROM low JOIN fresh f ON f.m = low.m AND f.s <> 30 AND f.s > low.low AND f.s <= low.anchor""")
def recut_keyframes(spark, sf_dir):
    """Where every shape lies after the cut, with the copies on the other side of new boundaries."""
    return _done(spark, sf_dir)["keyframes"].select("m", "id", "seg", "anchor", "source", "version")


@query("recut_rechecks", f"""WITH {CUT_SQL},
moved AS (SELECT DISTINCT m, os AS a, oe AS z FROM p x WHERE NOT EXISTS (SELECT 1 FROM p y WHERE y.m = x.m AND y.o = x.o AND y.s = y.os AND y.e = y.oe) UNION SELECT m, s, e FROM cut WHERE dropped)
SELECT DISTINCT kf.m, kf.anchor AS step FROM kf JOIN moved ON moved.m = kf.m AND kf.anchor BETWEEN a AND z""")
def recut_rechecks(spark, sf_dir):
    """Frozen frames that a cut touches: those of segments with other ends or dropped drawings."""
    return _done(spark, sf_dir)["rechecks"]


@query("recut_pairs", f"""WITH {CUT_SQL},
x AS (SELECT DISTINCT l_partkey AS m, (l_quantity::BIGINT + 11) // 12 AS seg, 'k' || (l_suppkey % 7) AS below FROM lineitem)
SELECT DISTINCT x.m, p.seg, x.below FROM x JOIN p ON p.m = x.m AND p.o = x.seg
UNION ALL SELECT * FROM x WHERE m NOT IN (FROM act) OR (seg > 4 AND NOT EXISTS (SELECT 1 FROM new n WHERE n.m = x.m AND n.seg = x.seg))""")
def recut_pairs(spark, sf_dir):
    """Exceptions of the layer order: copied by a split, united by a merge, replaced where a new segment takes their number."""
    return _done(spark, sf_dir)["pairs"].select("m", "seg", "below")


@query("recut_orders", f"""WITH {CUT_SQL},
x AS (SELECT l_partkey AS m, (l_quantity::BIGINT + 11) // 12 AS seg, 'k' || (l_suppkey % 7) AS e, min(l_orderkey) AS i FROM lineitem GROUP BY 1, 2, 3),
y AS (SELECT x.m, p.seg, x.e, x.i, p.o, p.o <> cut.keeper AS late FROM x JOIN p ON p.m = x.m AND p.o = x.seg JOIN cut ON cut.m = p.m AND cut.seg = p.seg),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY m, seg, e ORDER BY late, o) = 1),
w AS (SELECT m, seg, string_agg(e, ',' ORDER BY late, o, i, e) AS layers FROM z GROUP BY m, seg)
SELECT * FROM w UNION ALL SELECT m, seg, string_agg(e, ',' ORDER BY i, e) FROM x WHERE m NOT IN (FROM act) OR (seg > 4 AND NOT EXISTS (SELECT 1 FROM w WHERE w.m = x.m AND w.seg = x.seg)) GROUP BY m, seg""")
def recut_orders(spark, sf_dir):
    """Layer orders: the keeper's first, then what only the other pieces had."""
    return _done(spark, sf_dir)["orders"].select("m", "seg", F.array_join("layers", ",").alias("layers"))
