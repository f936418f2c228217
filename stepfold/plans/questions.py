"""Queries of the question generators that need certain answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import questions as Q
from stepfold.operators import state
from stepfold.plans.machine import GRAPH_SQL, VERBS, _graph
from stepfold.plans.registry import query
from stepfold.plans.rollups import BOXES_SQL, boxes
from stepfold.plans.tables import table

NOES_SQL = f"""{GRAPH_SQL}, v AS (SELECT * FROM (VALUES ('open', 'open'), ('remove', 'removed'), ('unscrew', 'removed')) x(verb, to_state)),
y AS (SELECT s.key, s.cls, s.state, v.verb, s.state <> 'removed' AND s.state <> v.to_state AS applies,
  EXISTS (SELECT 1 FROM u WHERE u.target = s.key AND (u.type = 'covered_by' OR (u.type = 'fastened_by' AND v.verb IN ('remove', 'open')) OR (u.type = 'connected_to' AND v.verb = 'remove'))) AS stopped FROM s, v),
no AS (SELECT key, verb, CASE WHEN applies THEN 'blocked_by_graph' ELSE 'inapplicable' END AS cause FROM y WHERE NOT applies OR stopped),
ok AS (SELECT key, verb FROM y WHERE applies AND NOT stopped)"""


def _noes(spark, sf_dir):
    current, edges = _graph(spark, sf_dir)
    verbs = current.select("cls").distinct().crossJoin(spark.createDataFrame(VERBS, "verb string, to_state string"))  # six classes, three verbs
    return current, Q.certain_noes(current, edges, verbs), state.legal_actions(current, edges, verbs)


@query("certain_noes", f"WITH {NOES_SQL} SELECT key, verb, cause FROM no")
def certain_noes(spark, sf_dir):
    return _noes(spark, sf_dir)[1]


@query("bounded_sets", f"""WITH {NOES_SQL}, m AS (SELECT key // 10 AS machine, verb || ':' || key AS a, key, verb FROM ok), d AS (SELECT key // 10 AS machine, verb || ':' || key AS a FROM ok WHERE verb = 'open' AND key % 3 = 0),
x AS (SELECT key // 10 AS machine, verb || ':' || key AS a FROM no)
SELECT machine, (SELECT string_agg(a, ',' ORDER BY a) FROM d WHERE d.machine = g.machine) AS must_include, coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM x WHERE x.machine = g.machine), '') AS must_not_include, (SELECT string_agg(a, ',' ORDER BY a) FROM m WHERE m.machine = g.machine) AS permitted FROM (SELECT DISTINCT machine FROM d) g""")
def bounded_sets(spark, sf_dir):
    """What each machine of ten parts lets be done, certainly forbids, and was shown to do."""
    current, noes, legal = _noes(spark, sf_dir)
    own = lambda df: df.withColumn("machine", F.floor(F.col("key") / 10))
    shown = current.where("key % 3 = 0").select("key", F.lit("open").alias("verb"))
    return Q.bounded_sets(own(shown), own(legal), own(noes), ["machine"])


@query("matched_noes", f"""WITH {NOES_SQL}, d AS (SELECT key // 10 AS machine, min(s.cls) AS cls FROM ok JOIN s USING (key) WHERE verb = 'open' GROUP BY 1),
n AS (SELECT no.key // 10 AS machine, no.verb, s.cls FROM no JOIN s USING (key))
SELECT d.machine, 'open' AS shown_verb, min(CASE WHEN n.verb = 'open' AND n.cls = d.cls THEN 0 WHEN n.verb = 'open' THEN 1 WHEN n.cls = d.cls THEN 2 ELSE 3 END) AS tier FROM d JOIN n USING (machine) GROUP BY 1""")
def matched_noes(spark, sf_dir):
    """How close the closest certain no of each machine comes to a demonstrated action."""
    current, noes, legal = _noes(spark, sf_dir)
    machine = F.floor(F.col("key") / 10).alias("machine")
    shown = legal.where("verb = 'open'").join(current.select("key", "cls"), "key").groupBy(machine).agg(F.min("cls").alias("cls")).withColumn("verb", F.lit("open"))
    rows = noes.join(current.select("key", "cls"), "key").select("*", machine)
    return Q.matched_noes(shown, rows, ["machine"], legal).select("machine", "shown_verb", "tier")


@query("answerable_pairs", """
WITH s AS (SELECT o_custkey AS f, count(*) FILTER (o_orderstatus = 'F') AS seen, count(*) FILTER (o_orderstatus <> 'F') AS blind FROM orders GROUP BY 1)
SELECT f, a AS answerable, least(seen, blind, 4)::BIGINT AS n FROM s, (VALUES (true), (false)) x(a) WHERE least(seen, blind) > 0""")
def answerable_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("f"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "visible").otherwise("out_of_view").alias("visibility"))
    return Q.answerable_pairs(rows, ["f"], "o_orderkey", 4).groupBy("f", "answerable").agg(F.count("*").alias("n"))


@query("referring", f"""WITH {BOXES_SQL}, k AS (SELECT frame, vec_id, 'c' || label AS cls, 's' || (vec_id % 3) AS state, x0 FROM b),
w AS (SELECT *, count(*) OVER (PARTITION BY frame, cls) AS n, count(*) OVER (PARTITION BY frame, cls, state) AS m, row_number() OVER (PARTITION BY frame, cls ORDER BY x0, vec_id) AS r FROM k)
SELECT frame, vec_id, CASE WHEN n = 1 THEN 'the ' || cls WHEN m = 1 THEN 'the ' || state || ' ' || cls ELSE 'the ' || CASE r WHEN 1 THEN 'left' ELSE 'right' END || ' ' || cls END AS phrase, CASE WHEN n = 1 THEN 'class' WHEN m = 1 THEN 'state' ELSE 'place' END AS family FROM w WHERE n <= 2 OR m = 1""")
def referring(spark, sf_dir):
    rows = boxes(spark, sf_dir).select("frame", "vec_id", F.concat(F.lit("c"), "label").alias("cls"), F.concat(F.lit("s"), F.col("vec_id") % 3).alias("state"), "x0")
    return Q.referring(rows, ["frame"], "vec_id", 1000)


@query("fastened_counts", "SELECT p_partkey // 100 AS machine, p_brand AS role, count(*) AS n FROM part WHERE p_size % 2 = 0 AND p_type = 'PROMO' GROUP BY 1, 2")
def fastened_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 100).alias("machine"), F.col("p_brand").alias("role"), F.when(F.col("p_type") == "PROMO", "screw").alias("cls"), F.when(F.col("p_size") % 2 == 0, "tight").alias("state"))
    return Q.fastened_counts(rows, ["machine"])


@query("exclusion_reasons", """
SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'no_graph_version' WHEN NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'no_constraint_edges' ELSE 'deadlock' END AS reason FROM customer
WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def exclusion_reasons(spark, sf_dir):
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    edges = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return Q.exclusion_reasons(k, k.where("k % 5 <> 0"), edges, k.where("k % 7 = 0"), "k")


@query("pointable_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N' AND l_linestatus = 'F' AND l_quantity > 5")
def pointable_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "N", "out_of_view").when(F.col("l_returnflag") == "A", "visible_tiny").otherwise("visible").alias("visibility"), F.lit("screw").alias("cls"), F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("x0"), F.when(F.col("l_linestatus") == "F", "verified").alias("status"))
    return Q.pointable(rows, True).select("l_orderkey", "l_linenumber", "l_partkey")


@query("corrupted_logs")
def corrupted_logs(spark, sf_dir):
    """The last five events of each user and the same with two neighbours swapped, of unknown validity (hash order; tested)."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    out = Q.corruptions(rows, ["user_id"], "event_id", "event_type", 5)
    return out.select("user_id", F.array_join("logged", ",").alias("logged"), F.array_join("corrupted", ",").alias("corrupted"))
