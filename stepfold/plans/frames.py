"""Queries of the frame index, key frames, pose re-cut and keyed deletes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepfold.operators import frames as R
from stepfold.plans.registry import query
from stepfold.plans.tables import table
from stepfold.session import tasks_for

INDEX_SQL = """
s AS (SELECT o_custkey AS desktop, o_orderkey AS step FROM orders),
l AS (SELECT o_custkey AS desktop, l_orderkey AS step, CASE l_linestatus WHEN 'F' THEN 'scan' ELSE 'oak' END AS view, 'step_' || l_linenumber AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10),
f AS (SELECT desktop, view, step, min(path) AS path, count(*) AS shots FROM l GROUP BY ALL),
x AS (SELECT s.desktop, v.view, s.step, f.path, coalesce(f.shots, 0) AS shots FROM s CROSS JOIN (VALUES ('scan'), ('oak')) v(view) LEFT JOIN f ON f.desktop = s.desktop AND f.step = s.step AND f.view = v.view)"""


def _index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("desktop"), F.col("o_orderkey").alias("step"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("step"), "l_linestatus", F.concat(F.lit("step_"), "l_linenumber").alias("path"))
    files = lines.repartition(tasks_for(lines), "step").join(orders, "step")
    views = spark.createDataFrame([("scan",), ("oak",)], "view string")
    return R.frame_index(orders, {"scan": files.where("l_linestatus = 'F'"), "oak": files.where("l_linestatus <> 'F'")}, views)


@query("frame_index", f"WITH {INDEX_SQL} SELECT * FROM x")
def frame_index(spark, sf_dir):
    return _index(spark, sf_dir)


@query("index_report", f"""WITH {INDEX_SQL}, g AS (SELECT desktop, view, step, step - row_number() OVER (PARTITION BY desktop, view ORDER BY step) AS run FROM x WHERE path IS NULL),
h AS (SELECT desktop, view, min(step) AS a, max(step) AS b FROM g GROUP BY desktop, view, run),
t AS (SELECT desktop, view, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS gaps FROM h GROUP BY ALL)
SELECT desktop, view, count(path) AS present, count(*) FILTER (path IS NULL) AS missing, coalesce(any_value(gaps), '') AS gaps FROM x LEFT JOIN t USING (desktop, view) GROUP BY desktop, view""")
def index_report(spark, sf_dir):
    return R.index_report(_index(spark, sf_dir), tasks_for(table(spark, sf_dir, "orders"), 2))


@query("index_round_trip", f"WITH {INDEX_SQL} SELECT * FROM x WHERE shots > 0")
def index_round_trip(spark, sf_dir):
    """The index written as documents and read back."""
    return R.from_documents(R.index_documents(_index(spark, sf_dir), tasks_for(table(spark, sf_dir, "orders"), 2))).where("shots > 0")


@query("stray_files", "SELECT l_orderkey AS step, l_partkey AS desktop, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_custkey = l_partkey)")
def stray_files(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("desktop"), F.col("o_orderkey").alias("step"))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("desktop"), F.col("l_orderkey").alias("step"), "l_linenumber")
    return R.stray_files(steps, files)


@query("folder_step", "SELECT p_partkey, nullif(regexp_extract(p_brand, '([0-9]+)$', 1), '')::BIGINT AS step FROM part")
def folder_step(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.folder_step(F.col("p_brand")).alias("step"))


@query("merged_aux", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'old' ELSE p_name END AS roi, p_type AS note, p_brand AS kept FROM part")
def merged_aux(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = F.when(F.col("p_partkey") % 3 == 0, F.create_map(F.lit("roi"), F.lit("old"), F.lit("note"), F.lit("x"), F.lit("kept"), "p_brand")).otherwise(F.create_map(F.lit("kept"), F.col("p_brand")))
    m = R.merged_aux(old, F.create_map(F.lit("roi"), "p_name", F.lit("note"), "p_type"), ["roi"])
    return p.select("p_partkey", m.alias("m")).select("p_partkey", *[F.col("m")[k].alias(k) for k in ("roi", "note", "kept")])


@query("keyframe_parts", "SELECT o_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def keyframe_parts(spark, sf_dir):
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("part"))
    out = R.with_parts(table(spark, sf_dir, "orders").select("o_orderkey"), parts, "o_orderkey")
    return out.select("o_orderkey", F.array_join(F.transform("parts", lambda p: F.concat_ws(":", p["idx"].cast("string"), p["part"].cast("string"))), ",").alias("parts"))


@query("bumped_versions", """WITH k AS (SELECT o_custkey, o_orderkey AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version FROM orders WHERE o_custkey % 3 <> 0)
SELECT * FROM k UNION ALL SELECT c_custkey, -1, coalesce((SELECT max(version) FROM k WHERE o_custkey = c_custkey), 0) + 1 FROM customer WHERE c_custkey % 2 = 0""")
def bumped_versions(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = table(spark, sf_dir, "orders").where("o_custkey % 3 <> 0").select("o_custkey", F.col("o_orderkey").alias("v"), F.row_number().over(w).cast("long").alias("version"))
    changes = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(-1).cast("long").alias("v"))
    return R.bump(k, changes, ["o_custkey"])


@query("guarded_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45))")
def guarded_delete(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    guard = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.delete_where(rows, rows.where("o_orderkey % 3 = 0"), ["o_orderkey"], guard)


@query("replaced_source", "SELECT p_partkey, p_brand AS source FROM part WHERE p_brand <> 'Brand#1' UNION ALL SELECT p_partkey + 1000000, 'Brand#1' FROM part WHERE p_size > 25")
def replaced_source(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"))
    fresh = table(spark, sf_dir, "part").where("p_size > 25").select((F.col("p_partkey") + 1000000).alias("p_partkey"))
    return R.replace_source(rows, fresh, "Brand#1")


@query("order_references", "SELECT 'k' || (l_partkey % 50) AS key, count(DISTINCT l_orderkey) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 GROUP BY 1")
def order_references(spark, sf_dir):
    pair = F.array(F.concat(F.lit("k"), (F.col("l_partkey") % 50).cast("string")), F.lit("body"))
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.collect_list(pair)).alias("layers"))
    broken = F.when(F.col("l_orderkey") % 7 == 0, F.concat(F.lit("{"), "layers")).otherwise(F.col("layers"))
    return R.order_references(g.select(broken.alias("layers")), "key")


ORDERS_SQL = """o AS (SELECT l_orderkey AS k, l_partkey % 5 AS e, min(l_linenumber) AS i FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
p AS (SELECT l_orderkey AS k, l_partkey % 5 AS e, min(-l_linenumber) AS i FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2),
b AS (SELECT k, e, 0 AS side, i FROM o UNION ALL SELECT k, e, 1, i FROM p WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = p.k AND o.e = p.e)),
m AS (SELECT k, e, row_number() OVER (PARTITION BY k ORDER BY side, i, e) AS r FROM b WHERE k IN (SELECT k FROM o) AND k IN (SELECT k FROM p))"""


def _orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 5).alias("e"), "l_linenumber")
    side = lambda rows, i, out: rows.groupBy("k", "e").agg(F.min(i).alias("i")).groupBy("k").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "e"))), lambda s: s["e"]).alias(out))
    return side(lines.where("l_linenumber <= 4"), F.col("l_linenumber"), "keeper").join(side(lines.where("l_linenumber >= 3"), -F.col("l_linenumber"), "other"), "k")


@query("merged_orders", f"WITH {ORDERS_SQL} SELECT k, string_agg(e::VARCHAR, ',' ORDER BY r) AS merged FROM m GROUP BY k")
def merged_orders(spark, sf_dir):
    return _orders(spark, sf_dir).select("k", F.array_join(R.merge_orders(F.col("keeper"), F.col("other")), ",").alias("merged"))


@query("turned_pairs", f"WITH {ORDERS_SQL}, q AS (SELECT k, e, row_number() OVER (PARTITION BY k ORDER BY i, e) AS r FROM p) SELECT a.k, a.e AS above, b.e AS below FROM q a JOIN q b ON a.k = b.k AND a.r < b.r JOIN m ma ON ma.k = a.k AND ma.e = a.e JOIN m mb ON mb.k = b.k AND mb.e = b.e WHERE ma.r > mb.r")
def turned_pairs(spark, sf_dir):
    return R.turned_pairs(_orders(spark, sf_dir), ["k"], "keeper", "other")


SEGMENTS_SQL = """old AS (SELECT p_partkey AS k, g.i AS seg, g.i * 10 + p_size % 7 AS start, g.i * 10 + 9 + p_size % 7 AS "end" FROM part, range(0, 4) g(i)),
new AS (SELECT p_partkey AS k, g.i AS seg, g.i * 13 AS start, g.i * 13 + 12 AS "end" FROM part, range(0, 3) g(i))"""


def _segments(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), "p_size")
    cut = lambda n, wide, by: p.withColumn("seg", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("k", "seg", (F.col("seg") * wide + by).alias("start"), (F.col("seg") * wide + wide - 1 + by).alias("end"))
    return cut(4, 10, F.col("p_size") % 7), cut(3, 13, F.lit(0))


@query("recut_keeper", f"""WITH {SEGMENTS_SQL}, b AS (SELECT new.k, new.seg, old.seg AS old_seg, old.start AS s, least(new."end", old."end") - greatest(new.start, old.start) + 1 AS overlap FROM new JOIN old ON new.k = old.k)
SELECT k, seg, arg_max(old_seg, (overlap, -s)) AS old_seg, max(overlap) AS overlap, count(*) AS contributors FROM b WHERE overlap > 0 GROUP BY k, seg""")
def recut_keeper(spark, sf_dir):
    old, new = _segments(spark, sf_dir)
    return R.recut_keeper(old, new, ["k"])


@query("rekeyed_keyframes", f"""WITH {SEGMENTS_SQL}, a AS (SELECT l_partkey AS k, l_orderkey, l_linenumber, l_quantity::BIGINT AS anchor FROM lineitem)
SELECT a.k, a.l_orderkey, a.l_linenumber, a.anchor, old.seg FROM a LEFT JOIN old ON old.k = a.k AND a.anchor BETWEEN old.start AND old."end\"""")
def rekeyed_keyframes(spark, sf_dir):
    old, _ = _segments(spark, sf_dir)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("anchor"))
    return R.rekeyed(rows, old, ["k"], "anchor")


PROPOSALS_SQL = """f AS (SELECT user_id AS desktop, event_id % 40 AS step, view, max(value) AS px FROM (SELECT *, unnest(CASE WHEN event_type = 'error' THEN ['a', 'b', 'c'] ELSE [CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END] END) AS view FROM events WHERE value >= 20) GROUP BY ALL)"""


def _proposals(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("desktop"), (F.col("event_id") % 40).alias("step"), F.when(F.col("event_type") == "error", "chassis").otherwise("part").alias("kind"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("view"), F.col("value").alias("px"))
    return R.proposals(e, 20.0, ["a", "b", "c"])


@query("break_proposals", f"WITH {PROPOSALS_SQL} SELECT * FROM f")
def break_proposals(spark, sf_dir):
    return _proposals(spark, sf_dir)


@query("imported_proposals", f"WITH {PROPOSALS_SQL} SELECT desktop, step, view, CASE WHEN step % 4 = 0 THEN -1 ELSE px END AS px, CASE WHEN step % 4 = 0 THEN 'rejected' ELSE 'proposed' END AS status FROM f")
def imported_proposals(spark, sf_dir):
    fresh = _proposals(spark, sf_dir)
    stored = fresh.where("step % 4 = 0").withColumn("px", F.lit(-1.0)).withColumn("status", F.lit("rejected"))
    return R.import_proposals(stored, fresh, ["desktop", "step", "view"])
