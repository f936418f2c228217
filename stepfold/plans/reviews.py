"""Queries of the review models: quality rules, coverage, work items, cache decisions, guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import quality
from stepfold.plans.registry import query
from stepfold.plans.tables import ENTITY, table


@query("quality_issues", """
SELECT l_orderkey::VARCHAR AS key, 'dangling order' AS rule FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 0)
UNION ALL SELECT o_orderkey::VARCHAR, 'no lines' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey::VARCHAR, 'shipped before ordered' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate""")
def quality_issues(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_shipdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    rules = {"dangling order": lines.join(orders.where("k % 50 <> 0"), "k", "left_anti"), "no lines": orders.join(lines, "k", "left_anti"), "shipped before ordered": lines.join(orders, "k").where("l_shipdate < o_orderdate")}
    return quality.issues(rules, "k")


@query("coverage", """
SELECT o_custkey, count(*) AS needed, count(*) FILTER (d) AS drawn, count(*) FILTER (NOT d) AS missing, count(*) FILTER (NOT d AND o_orderstatus = 'P') AS bench_missing
FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS d FROM orders) GROUP BY o_custkey""")
def coverage(spark, sf_dir):
    needed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    drawn = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return quality.coverage(needed, drawn, ["o_orderkey"], ["o_custkey"], F.col("o_orderstatus") == "P")


@query("task_cards", """
WITH s AS (SELECT user_id, event_type, CAST(ts AS DATE) AS d, count(*) % 3 AS s FROM events GROUP BY ALL),
days AS (SELECT DISTINCT d FROM s), p AS (SELECT user_id, event_type, CAST(d + INTERVAL 1 DAY AS DATE) AS d, s FROM s WHERE CAST(d + INTERVAL 1 DAY AS DATE) IN (SELECT d FROM days))
SELECT coalesce(n.user_id, p.user_id) AS user_id, coalesce(n.event_type, p.event_type) AS event_type, CAST(coalesce(n.d, p.d) AS VARCHAR) AS d, CASE WHEN p.s IS NULL THEN 'appear' WHEN n.s IS NULL THEN 'vanish' ELSE 'change' END AS kind
FROM s n FULL JOIN p ON n.user_id = p.user_id AND n.event_type = p.event_type AND n.d = p.d WHERE n.s IS DISTINCT FROM p.s""")
def task_cards(spark, sf_dir):
    """What each day changes against the day before, for every day that has events."""
    now = table(spark, sf_dir, "events").groupBy(ENTITY, "event_type", F.to_date("ts").alias("d")).agg((F.count("*") % 3).alias("s"))
    before = now.withColumn("d", F.date_add("d", 1)).join(now.select("d").distinct(), "d", "left_semi")
    return quality.task_cards(now, before, [ENTITY, "event_type", "d"], "s").select(ENTITY, "event_type", F.col("d").cast("string").alias("d"), "kind")


@query("cache_decisions", """
WITH i AS (SELECT p_partkey AS k, p_size AS size, p_type AS label FROM part WHERE p_partkey % 17 <> 0),
m AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS size, CASE WHEN p_partkey % 7 = 0 THEN 'X' ELSE p_type END AS label, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 2 END AS version FROM part WHERE p_partkey % 13 <> 0)
SELECT coalesce(i.k, m.k) AS k, CASE WHEN i.k IS NULL THEN 'drop' WHEN m.k IS NULL OR i.size <> m.size THEN 'copy' WHEN version <> 2 THEN 'rechoose' WHEN i.label <> m.label THEN 'relabel' ELSE 'skip' END AS decision FROM i FULL JOIN m ON i.k = m.k""")
def cache_decisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("size"), F.col("p_type").alias("label"))
    k = F.col("k")
    manifest = p.where("k % 13 <> 0").select("k", F.when(k % 5 == 0, -1).otherwise(F.col("size")).alias("size"), F.when(k % 7 == 0, "X").otherwise(F.col("label")).alias("label"), F.when(k % 3 == 0, 1).otherwise(2).alias("version"))
    return quality.cache_decisions(p.where("k % 17 <> 0"), manifest, ["k"], 2)


@query("implausible_imports", """
SELECT o_custkey, count(*) FILTER (o_orderkey % 2 = 0) < 0.6 * count(*) OR count(*) FILTER (o_orderstatus = 'P') > 5 OR count(*) FILTER (o_orderstatus = 'P') > 0.2 * count(*) AS refused FROM orders GROUP BY o_custkey""")
def implausible_imports(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey") % 2 == 0).alias("present"), F.count_if(F.col("o_orderstatus") == "P").alias("dropped"))
    return g.select("o_custkey", quality.implausible(F.col("n"), F.col("present"), F.col("dropped"), F.col("n")).alias("refused"))


@query("split_compound", "SELECT p_partkey, unnest(range(1, 1 + CASE WHEN p_name LIKE 'red%' THEN 3 ELSE 1 END)) AS part FROM part")
def split_compound(spark, sf_dir):
    n = F.when(F.col("p_name").startswith("red"), 3).otherwise(1).cast("long")
    return quality.split_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name"), n).select("p_partkey", "part")


@query("withheld_boxes", """
SELECT p_partkey, least(CASE WHEN a < 10 THEN 10 / a WHEN a > 20 THEN a / 20 ELSE 1 END, CASE WHEN a < 40 THEN 40 / a WHEN a > 45 THEN a / 45 ELSE 1 END) <= 1.2 AS kept FROM (SELECT p_partkey, p_size::DOUBLE AS a FROM part WHERE p_size > 0)""")
def withheld_boxes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where("p_size > 0")
    return rows.select("p_partkey", quality.within_bands(F.col("p_size").cast("double"), [(10.0, 20.0), (40.0, 45.0)], 1.2).alias("kept"))


@query("rule_coverage", """
SELECT p_type, CASE WHEN p_name LIKE '%bolt' THEN 'fastener' WHEN p_name LIKE '%ring' THEN 'seal' ELSE 'fallback' END AS rule, count(*) AS n FROM part GROUP BY 1, 2""")
def rule_coverage(spark, sf_dir):
    rule = F.when(F.col("p_name").endswith("bolt"), "fastener").when(F.col("p_name").endswith("ring"), "seal").otherwise("fallback")
    return table(spark, sf_dir, "part").groupBy("p_type", rule.alias("rule")).agg(F.count("*").alias("n"))
