"""Queries of aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepfold.operators import aggregates, tasks, windows
from stepfold.plans.registry import query
from stepfold.plans.tables import ENTITY, ORDER, table


@query(
    "work_rows",
    """
SELECT o_orderkey, coalesce(nullif(kind, ''), 'normal') AS kind FROM orders LEFT JOIN (
  SELECT l_orderkey AS o_orderkey, CASE max(l_returnflag) WHEN 'A' THEN '' ELSE max(l_returnflag) END AS kind FROM lineitem GROUP BY 1) USING (o_orderkey)
WHERE coalesce(nullif(kind, ''), 'normal') NOT IN ('R')""",
)
def work_rows(spark, sf_dir):
    top = F.max("l_returnflag")
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.when(top == "A", "").otherwise(top).alias("kind"))
    return aggregates.work_rows(table(spark, sf_dir, "orders").select("o_orderkey"), steps, ["o_orderkey"], "kind", ["R"])


@query(
    "counters",
    """
SELECT nation, counter, count(*) AS n FROM (
  SELECT c_nationkey AS nation, 'customers' AS counter FROM customer UNION ALL SELECT s_nationkey, 'suppliers' FROM supplier
  UNION ALL SELECT c_nationkey, 'orders' FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY nation, counter""",
)
def counters(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).join(customer, "c_custkey")
    return aggregates.counters({"customers": customer, "suppliers": table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")), "orders": orders}, ["nation"])


@query("pivot_counts", """
SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id""")
def pivot_counts(spark, sf_dir):
    return aggregates.pivot_counts(table(spark, sf_dir, "events").select(ENTITY, "event_type"), [ENTITY], "event_type", ["click", "purchase", "error"])


@query("moved_on", """
SELECT l_suppkey, count(*) AS n, sum(CAST(nullif(l_returnflag, 'N') IS DISTINCT FROM 'A' AS INTEGER))::BIGINT AS stale FROM lineitem GROUP BY l_suppkey""")
def moved_on(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.nullif(F.col("l_returnflag"), F.lit("N")).alias("digest"))
    return aggregates.moved_on(rows, ["l_suppkey"], "digest", F.lit("A"))


@query("operation_counts", """
SELECT user_id, count(*) AS n, count(*) - count(DISTINCT event_type) AS repeated, count(*) > 1 AS many FROM events GROUP BY user_id""")
def operation_counts(spark, sf_dir):
    return aggregates.operation_counts(table(spark, sf_dir, "events").select(ENTITY, "event_type"), [ENTITY], "event_type")


@query("collisions", """
SELECT l_orderkey, sum(n - 1)::BIGINT AS collisions FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def collisions(spark, sf_dir):
    return aggregates.collisions(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], ["l_orderkey"])


@query("class_histogram", """
SELECT p_type, n, row_number() OVER (ORDER BY n DESC, p_type) AS rank FROM (SELECT p_type, count(*) AS n FROM part GROUP BY p_type)""")
def class_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "p_type")).cast("long"))


@query("majority_accuracy", """
WITH c AS (SELECT lang, source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3),
t AS (SELECT lang, source, max(n) AS top, sum(n)::BIGINT AS n FROM c GROUP BY 1, 2)
SELECT lang, sum(top) / sum(n) AS accuracy, sum(n)::BIGINT AS n FROM t GROUP BY lang""")
def majority_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return aggregates.majority_accuracy(rows, ["lang"], "source", "quality")


@query("shortcut_report", """
WITH n AS (SELECT lang, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)
SELECT lang, toxic, n, max(n) OVER (PARTITION BY lang) / sum(n) OVER (PARTITION BY lang) AS majority_rate FROM n""")
def shortcut_report(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return aggregates.shortcut_report(rows, "lang", "toxic")


@query("option_shortcut", """
WITH r AS (SELECT l_shipdate AS record, l_returnflag AS verb, l_linestatus = 'O' AS ok FROM lineitem),
w AS (SELECT verb, avg(ok::INTEGER) AS rate FROM r GROUP BY verb),
o AS (SELECT DISTINCT record, verb, ok FROM r),
p AS (SELECT record, arg_max(ok, (rate, verb, ok)) AS hit, count(*) AS k, count(*) FILTER (ok) AS c FROM o JOIN w USING (verb) GROUP BY record)
SELECT count(*) AS records, count(*) FILTER (hit) AS hits, round(avg(c / k), 9) AS baseline FROM p""")
def option_shortcut(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("record"), F.col("l_returnflag").alias("verb"), (F.col("l_linestatus") == "O").alias("ok"))
    rates = aggregates.win_rates(rows, "verb", F.col("ok")).select("verb", "win_rate")
    scored = rows.distinct().join(rates, "verb")
    per = scored.groupBy("record").agg(F.max_by("ok", F.struct("win_rate", "verb", "ok")).alias("hit"), F.count("*").alias("k"), F.count_if("ok").alias("c"))
    return per.agg(F.count("*").alias("records"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("c") / F.col("k")), 9).alias("baseline"))


@query("percentile_bands", """
WITH s AS (SELECT p_brand, list_sort(list(p_retailprice)) AS v FROM part GROUP BY p_brand HAVING count(*) >= 50)
SELECT p_brand, v[1 + round_even(0.05 * (len(v) - 1), 0)::INTEGER] AS p05, v[1 + round_even(0.5 * (len(v) - 1), 0)::INTEGER] AS p50, v[1 + round_even(0.95 * (len(v) - 1), 0)::INTEGER] AS p95, len(v) AS n FROM s""")
def percentile_bands(spark, sf_dir):
    return aggregates.bands(table(spark, sf_dir, "part").select("p_brand", "p_retailprice"), ["p_brand"], "p_retailprice", 50)


@query("fitted_bands", """
WITH m AS (SELECT l_returnflag, l_partkey, l_linestatus, quantile_cont(l_quantity, 0.5) AS m FROM lineitem GROUP BY 1, 2, 3)
SELECT l_returnflag, quantile_cont(m, 0.05) AS low, quantile_cont(m, 0.95) AS high, count(*) AS parts, count(DISTINCT l_linestatus) AS groups FROM m GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT l_linestatus) >= 2""")
def fitted_bands(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_partkey", "l_linestatus", "l_quantity")
    return aggregates.fitted_bands(rows, ["l_returnflag"], ["l_partkey"], "l_quantity", "l_linestatus", 5, 2)


BOXES_SQL = """
b AS (SELECT vec_id, label, floor((embedding[1]::DOUBLE + 1) * 100)::BIGINT AS x0, floor((embedding[2]::DOUBLE + 1) * 100)::BIGINT AS y0,
  floor((embedding[1]::DOUBLE + 1) * 100)::BIGINT + 5 + floor(abs(embedding[3]::DOUBLE) * 200)::BIGINT AS x1, floor((embedding[2]::DOUBLE + 1) * 100)::BIGINT + 5 + floor(abs(embedding[4]::DOUBLE) * 200)::BIGINT AS y1,
  vec_id // 50 AS frame FROM embeddings)"""


def boxes(spark, sf_dir):
    """Boxes made of the first four coordinates of each embedding, 50 a frame."""
    e = lambda i: F.col("embedding")[i].cast("double")
    low = lambda i: F.floor((e(i) + 1) * 100)
    side = lambda i: 5 + F.floor(F.abs(e(i)) * 200)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", low(0).alias("x0"), low(1).alias("y0"), (low(0) + side(2)).alias("x1"), (low(1) + side(3)).alias("y1"), F.floor(F.col("vec_id") / 50).alias("frame"))


def _combined(name, how, sql):
    @query(name, f"WITH {BOXES_SQL}, m AS (SELECT frame, count(*) AS n, list_sort(list((x1 - x0) * (y1 - y0))) AS a FROM b GROUP BY frame) {sql}")
    def run(spark, sf_dir):
        return aggregates.combine_boxes(boxes(spark, sf_dir), ["frame"], how)

    return run


boxes_union = _combined("boxes_union", "union", "SELECT frame, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY frame")
boxes_trimmed = _combined("boxes_trimmed", "trimmed", "SELECT frame, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b JOIN m USING (frame) WHERE n < 3 OR (x1 - x0) * (y1 - y0) <= 1.5 * a[1 + n // 2] GROUP BY frame")
boxes_median = _combined("boxes_median", "median", "SELECT frame, list_sort(list(x0))[1 + count(*) // 2] AS x0, list_sort(list(y0))[1 + count(*) // 2] AS y0, list_sort(list(x1))[1 + count(*) // 2] AS x1, list_sort(list(y1))[1 + count(*) // 2] AS y1 FROM b GROUP BY frame")


@query("all_combinations", """
WITH g AS (SELECT * FROM (VALUES ('ECONOMY'), ('SMALL'), ('NONE')) a(p_type), (VALUES ('Brand#1'), ('Brand#2')) b(p_brand))
SELECT p_type, p_brand, count(p_partkey) AS n, round(avg(p_retailprice), 6) AS mean, quantile_cont(p_retailprice, 0.5) AS median, avg(CAST(p_retailprice >= 1000 AS INTEGER)) AS rate
FROM g LEFT JOIN part USING (p_type, p_brand) GROUP BY ALL""")
def all_combinations(spark, sf_dir):
    g = aggregates.all_combinations(table(spark, sf_dir, "part"), {"p_type": ["ECONOMY", "SMALL", "NONE"], "p_brand": ["Brand#1", "Brand#2"]}, "p_retailprice", 1000.0)
    return g.withColumn("mean", F.round("mean", 6))


@query("clock", """
SELECT user_id, min(CASE WHEN event_type = 'error' THEN event_id END) AS removed_at, max(CASE WHEN event_type = 'click' THEN event_id END) AS touched_at FROM events GROUP BY user_id""")
def clock(spark, sf_dir):
    return aggregates.clock(table(spark, sf_dir, "events"), [ENTITY], "event_id", F.col("event_type") == "error", F.col("event_type") == "click")


@query("water_fill")
def water_fill(spark, sf_dir):
    """Quotas of 300 over the sources of documents (an ordered fold; tested against a plain loop)."""
    n = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return aggregates.water_fill(n, [], "source", 300)


@query("newest_ops", "SELECT event_id, user_id, rank FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3")
def newest_ops(spark, sf_dir):
    w = Window.partitionBy(ENTITY).orderBy(*[F.col(c).desc() for c in ORDER])
    return table(spark, sf_dir, "events").select("event_id", ENTITY, "ts").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 3").drop("ts")


@query("best_frame", """
WITH m AS (SELECT event_id, user_id, value, CASE WHEN value < 3 THEN 'dark' WHEN value > 40 THEN 'saturated' END AS reject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT user_id, CASE WHEN max(CASE WHEN i = 0 AND reject IS NULL THEN 1 END) = 1 THEN arg_min(event_id, i)
  ELSE coalesce(arg_max(event_id, (value, -i)) FILTER (reject IS NULL), arg_min(event_id, i)) END AS event_id,
  CASE WHEN max(CASE WHEN i = 0 AND reject IS NULL THEN 1 END) = 1 THEN 'first' WHEN count(*) FILTER (reject IS NULL) > 0 THEN 'sharpest' ELSE 'all rejected' END AS reason FROM m GROUP BY user_id""")
def best_frame(spark, sf_dir):
    """The first event unless it is rejected, else the passing one of the largest value, ties to the earliest."""
    m = windows.ordinals(table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "value"), [ENTITY], ORDER, "i")
    m = m.withColumn("i", F.col("i") - 1).withColumn("reject", F.when(F.col("value") < 3, "dark").when(F.col("value") > 40, "saturated"))
    ok = F.col("reject").isNull()
    g = m.groupBy(ENTITY).agg(F.max(ok & (F.col("i") == 0)).alias("first_ok"), F.min_by("event_id", "i").alias("first"), F.max_by(F.when(ok, F.col("event_id")), F.when(ok, F.struct("value", -F.col("i")))).alias("sharpest"))
    picked = F.when(F.col("first_ok"), F.col("first")).otherwise(F.coalesce("sharpest", "first"))
    return g.select(ENTITY, picked.alias("event_id"), F.when(F.col("first_ok"), "first").when(F.col("sharpest").isNotNull(), "sharpest").otherwise("all rejected").alias("reason"))


@query("unique_argmin", """
WITH r AS (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY floor(value)) AS r FROM events),
n AS (SELECT user_id, min(event_id) AS event_id, count(*) AS n FROM r WHERE r = 1 GROUP BY user_id)
SELECT user_id, CASE WHEN n = 1 THEN event_id ELSE -1 END AS event_id FROM n""")
def unique_argmin(spark, sf_dir):
    """The event of the smallest whole value of each user; -1 where several tie."""
    e = table(spark, sf_dir, "events").select(ENTITY, "event_id", F.floor("value").alias("v"))
    first = e.groupBy(ENTITY, "v").agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    g = first.groupBy(ENTITY).agg(F.min_by(F.struct("event_id", "n"), "v").alias("m"))
    return g.select(ENTITY, F.when(F.col("m.n") == 1, F.col("m.event_id")).otherwise(F.lit(-1).cast("long")).alias("event_id"))


@query("frozen_union", "SELECT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def frozen_union(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    return a.union(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")).distinct()


@query("dedupe_edges", """
SELECT l_partkey, l_suppkey, l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1 AND l_partkey <> l_suppkey""")
def dedupe_edges(spark, sf_dir):
    w = Window.partitionBy("l_partkey", "l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").where("l_partkey <> l_suppkey").withColumn("_r", F.row_number().over(w))
    return rows.where("_r = 1").select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity")


@query("flagship_revenue", """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def flagship_revenue(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("nearest_ranks", """
SELECT l_suppkey, v[round_even(0.9 * (len(v) - 1), 0)::INTEGER + 1] AS p90, v[len(v) // 2 + 1] AS middle FROM (SELECT l_suppkey, list_sort(list(l_quantity)) AS v FROM lineitem GROUP BY l_suppkey)""")
def nearest_ranks(spark, sf_dir):
    """Percentiles that are values themselves: the 90th by nearest rank, and the upper middle."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list("l_quantity")).alias("v"))
    return v.select("l_suppkey", aggregates.nearest_rank(F.col("v"), 0.9).alias("p90"), aggregates.upper_middle(F.col("v")).alias("middle"))


@query("id_collisions", """
SELECT l_partkey % 50 AS id, count(DISTINCT (l_returnflag, l_suppkey, l_linenumber)) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_suppkey, l_linenumber)) > 1""")
def id_collisions(spark, sf_dir):
    """Record ids that stand for more than one question."""
    records = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("id"), F.col("l_returnflag").alias("task"), F.col("l_suppkey").alias("entity"), F.col("l_linenumber").alias("step"))
    return tasks.id_collisions(records)
