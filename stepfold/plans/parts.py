"""Queries of small values, log import steps and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.functions import parts as P
from stepfold.operators import imports as I
from stepfold.plans.registry import query
from stepfold.plans.tables import ENTITY, table


@query("brand_model", """
WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'HP  ' || p_name WHEN 1 THEN 'Optiplex ' || p_size WHEN 2 THEN p_name ELSE 'dell' END AS raw FROM part)
SELECT p_partkey, CASE WHEN raw LIKE 'HP %' THEN 'HP' WHEN raw LIKE 'Optiplex%' OR raw = 'dell' THEN 'Dell' END AS brand, CASE WHEN raw LIKE 'HP %' THEN trim(substr(raw, 4)) WHEN raw = 'dell' THEN NULL ELSE raw END AS model FROM n""")
def brand_model(spark, sf_dir):
    n = F.col("p_size") % 4
    raw = F.when(n == 0, F.concat(F.lit("HP  "), "p_name")).when(n == 1, F.concat(F.lit("Optiplex "), F.col("p_size").cast("string"))).when(n == 2, F.col("p_name")).otherwise("dell")
    return table(spark, sf_dir, "part").select("p_partkey", P.brand_model(raw).alias("b")).select("p_partkey", "b.brand", "b.model")


@query("form_factor", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'sff' WHEN p_size % 3 = 1 THEN 'mt' END AS form FROM part""")
def form_factor(spark, sf_dir):
    n = F.col("p_size") % 3
    raw = F.when(n == 0, "HP 800 Small-Form  Factor").when(n == 1, "Acer MT").otherwise("HP smt")
    return table(spark, sf_dir, "part").select("p_partkey", P.form_factor(raw).alias("form"))


@query("captive_screws", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN coalesce(p_brand = 'Brand#1' AND p_size % 2 = 0, false) END AS captive FROM part")
def captive_screws(spark, sf_dir):
    brand = F.when(F.col("p_brand") == "Brand#1", "DELL Optiplex").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", P.is_captive(F.when(F.col("p_type") == "PROMO", "screw").otherwise("fan"), F.when(F.col("p_size") % 2 == 0, "cpu_cooler"), brand).alias("captive"))


@query("rounded_values", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity % 3 = 0 THEN (l_quantity / 3)::BIGINT::VARCHAR ELSE 'x' END AS n, (l_quantity = 10) AS same FROM lineitem")
def rounded_values(spark, sf_dir):
    q = F.col("l_quantity")
    n = F.when(q % 3 == 0, P.number_text(P.rounded(q / 3))).otherwise("x")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n.alias("n"), P.is_identity(q / 10, F.lit(0.0), q - 10, F.lit(1e-12)).alias("same"))


@query("extra_attrs", "SELECT p_partkey, p_size % 2 = 0 AS extra, p_size % 3 = 0 AS implied FROM part")
def extra_attrs(spark, sf_dir):
    attrs = F.create_map(F.lit("added_by"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")), F.lit("implied"), F.when(F.col("p_size") % 3 == 0, "yes"))
    return table(spark, sf_dir, "part").select("p_partkey", P.has_attr(attrs, "added_by").alias("extra"), P.has_attr(attrs, "implied").alias("implied"))


@query("width_buckets", "SELECT p_partkey, CASE WHEN p_size < 12 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS bucket FROM part")
def width_buckets(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.bucket(F.col("p_size"), [("small", 0, 12), ("middle", 12, 30), ("large", 30, 1e9)]).alias("bucket"))


@query("motion_classes", """
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'undetermined' WHEN p_size % 4 >= 2 AND c THEN 'both' WHEN p_size % 4 >= 2 THEN 'camera' WHEN c THEN 'chassis' ELSE 'none' END AS motion
FROM (SELECT *, p_size >= 12 AND p_retailprice BETWEEN 950 AND 1050 AS c FROM part)""")
def motion_classes(spark, sf_dir):
    s = F.col("p_size")
    ratio = F.when(F.col("p_retailprice").between(950, 1050), 1.0).otherwise(2.0)
    return table(spark, sf_dir, "part").select("p_partkey", P.motion(s % 4, s % 7 != 0, s, ratio).alias("motion"))


@query("view_tiers", "SELECT DISTINCT l_returnflag AS view, CASE l_returnflag WHEN 'A' THEN 'gold' WHEN 'R' THEN 'silver' ELSE 'bronze' END AS tier FROM lineitem")
def view_tiers(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("view")).distinct()
    return v.withColumn("tier", P.view_tier(F.col("view"), {"A": "gold", "R": "silver", "N": "bronze"}))


@query("blocking_problems", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '5-%'")
def blocking_problems(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(P.starts_with_any(F.col("o_orderpriority"), ["1-", "5-"])).select("o_orderkey")


@query("percent_boxes", """
SELECT p_partkey, greatest(p_size * 2 - 10, 0)::BIGINT AS x0, 30::BIGINT AS y0, least(p_size * 2 + 41, 120)::BIGINT AS x1, 61::BIGINT AS y1 FROM part WHERE p_size % 2 = 0""")
def percent_boxes(spark, sf_dir):
    x = (F.col("p_size") * 2 - 10) / 1.2
    corner = lambda a, b: F.array(a, F.lit(b))
    points = F.array(corner(x, 30.0), corner(x + 50 / 1.2, 30.0), corner(x, 60.0))
    points = F.when(F.col("p_size") % 2 == 0, points).otherwise(F.slice(points, 1, 2))
    rows = table(spark, sf_dir, "part").select("p_partkey", P.percent_box(points, F.lit(120).cast("long"), F.lit(100).cast("long")).alias("b"))
    return rows.where("b is not null").select("p_partkey", "b.*")


@query("native_uploads", "SELECT p_partkey, p_size = 0 OR p_size % 5 = 0 AS native FROM part")
def native_uploads(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", P.is_native(F.when(s > 0, F.when(s % 5 == 0, 400.0).otherwise(500.0)), F.lit(300.0), F.lit(4 / 3)).alias("native"))


@query("implied_instances", """
WITH i AS (SELECT p_partkey // 10 AS machine, p_type AS cls FROM part), r AS (SELECT DISTINCT p_partkey // 10 AS machine, 'PROMO' AS cls FROM part WHERE p_size % 3 = 0 UNION SELECT DISTINCT p_partkey // 10, 'SMALL' FROM part WHERE p_size % 5 = 0)
SELECT machine, cls, cls || '.01' AS key FROM r WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.machine = r.machine AND i.cls = r.cls) AND NOT (cls = 'SMALL' AND machine % 4 = 0)""")
def implied_instances(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("machine"), F.col("p_type").alias("cls"), "p_size")
    refs = p.where("p_size % 3 = 0").select("machine", F.lit("PROMO").alias("cls")).union(p.where("p_size % 5 = 0").select("machine", F.lit("SMALL")))
    declined = p.where("machine % 4 = 0").select("machine", F.lit("SMALL").alias("cls"))
    return I.implied_instances(p.withColumn("key", F.concat("cls", F.lit(".x"))), refs, declined, None)


@query("carried_notes", """
SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'LS: ' || o_orderstatus ELSE 'own' || chr(10) || 'LS: ' || o_orderstatus END AS notes FROM orders WHERE o_orderkey % 5 <> 0""")
def carried_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    previous = o.where("o_orderkey % 3 <> 0").select(k.alias("k"), F.concat(F.lit("old\nLS: "), "o_orderstatus").alias("notes"))
    steps = o.where("o_orderkey % 5 <> 0").select(k.alias("k"), F.when(k % 3 == 2, "own").alias("notes"))
    return I.carry_notes(steps, previous, ["k"], "LS:")[0]


@query("lost_notes", "SELECT count(*) AS lost FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 <> 0")
def lost_notes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.lit("LS: x").alias("notes"))
    return I.carry_notes(o.where("k % 5 <> 0"), o.where("k % 3 <> 0"), ["k"], "LS:")[1]


@query("vocabulary_issues", "SELECT event_id, 'unknown verb' AS issue FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'unknown tool' FROM events WHERE value < 5")
def vocabulary_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("verb"), F.when(F.col("value") < 5, "spoon").otherwise("driver").alias("tool"))
    return I.vocabulary_issues(rows, "event_id", ["click", "signup", "purchase", "view"], ["driver"])


@query("planned_extras", """
WITH h AS (SELECT p_type AS cls, max(p_partkey % 50) AS last FROM part GROUP BY 1)
SELECT cls, last + i AS ordinal, cls || '.' || lpad((last + i)::VARCHAR, greatest(2, len((last + i)::VARCHAR))::INTEGER, '0') AS key FROM h, range(1, 4) t(i)""")
def planned_extras(spark, sf_dir):
    have = table(spark, sf_dir, "part").select(F.col("p_type").alias("cls"), (F.col("p_partkey") % 50).alias("ordinal"))
    wanted = have.select("cls").distinct().withColumn("n", F.lit(3))
    return I.plan_extras(have, wanted, ["cls"])


@query("socket_hosts", """
WITH i AS (SELECT p_partkey // 10 AS machine, p_type AS cls, min(p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE i.first::VARCHAR END AS host FROM part LEFT JOIN i ON i.machine = p_partkey // 10 AND i.cls = 'PROMO'""")
def socket_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).alias("machine"), F.col("p_partkey").alias("k"), F.col("p_type").alias("cls"), "p_size", "p_brand")
    rows = p.select("machine", "k", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("plug on "), "p_brand")).otherwise("plug").alias("raw"), F.lit("PROMO").alias("wanted"))
    return I.socket_hosts(rows, p.select("machine", "cls", F.col("k").alias("place"), F.col("k").cast("string").alias("key")), r"on (\S+)").select("k", "host")


@query("expected_steps", "SELECT o_custkey AS desktop, count(*) AS expected, count(*) FILTER (o_orderkey % 9 <> 0) AS found FROM orders GROUP BY 1 HAVING count(*) <> count(*) FILTER (o_orderkey % 9 <> 0)")
def expected_steps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("desktop"), "o_orderkey")
    expected = o.groupBy("desktop").agg(F.count("*").alias("expected"))
    return I.short_logs(o.where("o_orderkey % 9 <> 0"), expected)


@query("ranked_candidates", """
WITH e AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id) AS best, abs(event_id % 97 - 40) AS d FROM events)
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value < best - 30, CASE WHEN value >= best - 30 THEN d END, value DESC, event_id) AS rank FROM e""")
def ranked_candidates(spark, sf_dir):
    """Candidates by change; those nearly as good as the best by distance to the point before."""
    e = table(spark, sf_dir, "events").select(ENTITY, "event_id", "value")
    return I.ranked(e, [ENTITY], "value", F.abs(F.col("event_id") % 97 - 40), "event_id", 30.0).select(ENTITY, "event_id", "rank")


@query("frame_hits", "SELECT o_custkey, count(*) AS truths, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)) AS hits FROM orders GROUP BY 1")
def frame_hits(spark, sf_dir):
    truths = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    matched = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return I.frame_hits(truths, matched, ["o_custkey"], "o_orderkey")


@query("widest_gaps", """
WITH j AS (SELECT o_orderkey, o_custkey, max(l_extendedprice) - o_totalprice AS gap FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice),
d AS (SELECT o_custkey, max(gap) AS gap FROM j GROUP BY 1) SELECT o_custkey, round(gap, 4) AS gap FROM d ORDER BY d.gap DESC, o_custkey LIMIT 20""")
def widest_gaps(spark, sf_dir):
    """The twenty customers of the widest gap, each once (a top-k report)."""
    most = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("most"))
    j = table(spark, sf_dir, "orders").join(most, "o_orderkey").select("o_custkey", (F.col("most") - F.col("o_totalprice")).alias("gap"))
    return I.largest_once(j, ["o_custkey"], "gap", 20).select("o_custkey", F.round("gap", 4).alias("gap"))


@query("quartiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3 FROM events GROUP BY 1")
def quartiles(spark, sf_dir):
    q = I.quartile_table(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return q.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])


@query("rationale_chains", "SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AS valid FROM orders")
def rationale_chains(spark, sf_dir):
    op = F.when(F.col("o_orderkey") % 7 == 0, "guess").otherwise("observe")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), I.valid_chain(I.chain([(op, "o_orderstatus"), (F.lit("conclude"), "o_orderpriority")])).alias("valid"))
