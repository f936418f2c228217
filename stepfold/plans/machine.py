"""Queries of the state machine, the constraint graph and the materialized view."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import state, view, windows
from stepfold.plans.registry import query
from stepfold.plans.tables import table

EFFECTS = [("click", "open"), ("signup", "closed"), ("purchase", "removed")]
EVENTS_SQL = """
a AS (SELECT event_id, event_id // 20 AS k, ts, event_type, CASE event_type WHEN 'click' THEN 'open' WHEN 'signup' THEN 'closed' WHEN 'purchase' THEN 'removed' END AS new FROM events WHERE value >= 2),
e AS (SELECT * FROM (SELECT *, coalesce(lag(new) OVER (PARTITION BY k ORDER BY ts, event_id), 'closed') AS old FROM a WHERE new IS NOT NULL) WHERE old <> new)"""


def _events(spark, sf_dir):
    """Changes of parts, from the event log, 20 events each: an action fails where its value is under 2."""
    actions = table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 20).alias("k"), "ts", "event_type", "value")
    effects = spark.createDataFrame(EFFECTS, "event_type string, new string")
    return state.events_from_actions(actions, effects, ["k"], ["ts", "event_id"], "event_type", F.col("value") >= 2, "closed").select("event_id", "k", "ts", "old", "new")


@query("events_from_actions", f"WITH {EVENTS_SQL} SELECT event_id, k, old, new FROM e")
def events_from_actions(spark, sf_dir):
    return _events(spark, sf_dir).drop("ts")


@query("state_at_step", f"WITH {EVENTS_SQL} SELECT k, arg_max(new, (ts, event_id)) AS state FROM e WHERE ts <= TIMESTAMP '2024-01-15' GROUP BY k")
def state_at_step(spark, sf_dir):
    upto = F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")
    return windows.snapshot(_events(spark, sf_dir), ["k"], ["ts", "event_id"], "new", upto).select("k", F.col("new").alias("state"))


@query("validate_events", f"""
WITH {EVENTS_SQL}, c AS (SELECT event_id, k, ts, CASE WHEN event_id % 9 = 0 THEN 'lost' ELSE new END AS new, old FROM e)
SELECT event_id, issue FROM (SELECT event_id, CASE WHEN new = 'lost' THEN 'unknown state' WHEN lag(new) OVER w IS NOT NULL AND lag(new) OVER w <> old THEN 'wrong old' END AS issue FROM c WINDOW w AS (PARTITION BY k ORDER BY ts, event_id)) WHERE issue IS NOT NULL""")
def validate_events(spark, sf_dir):
    broken = _events(spark, sf_dir).withColumn("new", F.when(F.col("event_id") % 9 == 0, "lost").otherwise(F.col("new")))
    return state.validate_events(broken, ["k"], ["ts", "event_id"], ["open", "closed", "removed"]).select("event_id", "issue")


TREE_SQL = "t AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent, p_size % 3 > 0 AS attached, p_type <> 'PROMO' AS takes FROM part)"


def _tree(spark, sf_dir):
    """Parts as a tree: the parent of part n is part n // 4."""
    parent = F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), parent.alias("parent"), (F.col("p_size") % 3 > 0).alias("attached"), (F.col("p_type") != "PROMO").alias("takes"))


@query("ancestry", f"""
WITH RECURSIVE {TREE_SQL}, c AS (SELECT parent AS ancestor, k AS descendant, 1 AS distance FROM t WHERE parent IS NOT NULL UNION ALL SELECT c.ancestor, t.k, c.distance + 1 FROM c JOIN t ON t.parent = c.descendant)
SELECT ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM c""")
def ancestry(spark, sf_dir):
    return state.closure(_tree(spark, sf_dir).where("parent is not null"), "parent", "k")


@query("removal_cascade", f"""
WITH RECURSIVE {EVENTS_SQL}, {TREE_SQL}, r AS (SELECT k, min(epoch_us(ts)) AS step FROM e WHERE new = 'removed' GROUP BY k),
c AS (SELECT parent AS ancestor, k AS descendant FROM t WHERE parent IS NOT NULL AND attached UNION ALL SELECT c.ancestor, t.k FROM c JOIN t ON t.parent = c.descendant WHERE t.attached),
f AS (SELECT descendant AS k, min(step) AS at, arg_min(ancestor, (step, ancestor)) AS ancestor FROM c JOIN r ON r.k = c.ancestor JOIN t ON t.k = c.ancestor AND t.takes GROUP BY descendant)
SELECT t.k, CASE WHEN f.at IS NOT NULL AND (r.step IS NULL OR r.step >= f.at) THEN f.at ELSE r.step END AS gone_at, CASE WHEN f.at IS NOT NULL AND (r.step IS NULL OR r.step >= f.at) THEN f.ancestor ELSE -1 END AS left_with
FROM t LEFT JOIN r USING (k) LEFT JOIN f USING (k) WHERE r.step IS NOT NULL OR f.at IS NOT NULL""")
def removal_cascade(spark, sf_dir):
    removed = _events(spark, sf_dir).where("new = 'removed'").groupBy("k").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("step"))
    gone = state.removal_cascade(_tree(spark, sf_dir), removed, "k", "parent", F.col("attached"), F.col("takes"))
    return gone.fillna(-1, ["left_with"])


GRAPH_SQL = f"""{EVENTS_SQL}, s AS (SELECT p_partkey AS key, p_type AS cls, coalesce(st, 'closed') AS state FROM part LEFT JOIN (SELECT k, arg_max(new, (ts, event_id)) AS st FROM e GROUP BY k) ON k = p_partkey),
h AS (SELECT DISTINCT l_partkey AS target, l_suppkey AS blocker, CASE l_returnflag WHEN 'R' THEN 'fastened_by' WHEN 'A' THEN 'covered_by' ELSE 'connected_to' END AS type,
  CASE (l_partkey + l_suppkey) % 5 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted_orphan' WHEN 2 THEN 'rejected_orphan' WHEN 3 THEN 'accepted' ELSE 'proposed' END AS status FROM lineitem WHERE l_quantity > 40),
g AS (SELECT target, blocker, type FROM h WHERE status NOT IN ('rejected', 'accepted_orphan', 'rejected_orphan')),
u AS (SELECT g.* FROM g LEFT JOIN s ON s.key = g.blocker WHERE NOT (s.state IS NULL OR s.state = 'removed' OR (type = 'covered_by' AND s.state = 'open')))"""
VERBS = [("open", "open"), ("remove", "removed"), ("unscrew", "removed")]


def _graph(spark, sf_dir):
    events = _events(spark, sf_dir)
    now = windows.snapshot(events, ["k"], ["ts", "event_id"], "new").select(F.col("k").alias("key"), F.col("new").alias("st"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_type").alias("cls"))
    current = parts.join(now, "key", "left").select("key", "cls", F.coalesce("st", F.lit("closed")).alias("state"))
    kind = F.when(F.col("l_returnflag") == "R", "fastened_by").when(F.col("l_returnflag") == "A", "covered_by").otherwise("connected_to")
    edges = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("blocker"), kind.alias("type")).distinct()
    nth = (F.col("target") + F.col("blocker")) % 5
    status = F.when(nth == 0, "rejected").when(nth == 1, "accepted_orphan").when(nth == 2, "rejected_orphan").when(nth == 3, "accepted").otherwise("proposed")
    return current, edges.withColumn("mode", F.lit(None).cast("string")).withColumn("status", status)


@query("unmet_edges", f"WITH {GRAPH_SQL} SELECT target, blocker, type FROM u")
def unmet_edges(spark, sf_dir):
    current, edges = _graph(spark, sf_dir)
    return state.unmet(edges, current).select("target", "blocker", "type")


@query("legal_actions", f"""
WITH {GRAPH_SQL}, v AS (SELECT * FROM (VALUES ('open', 'open'), ('remove', 'removed'), ('unscrew', 'removed')) x(verb, to_state))
SELECT s.key, v.verb FROM s, v WHERE s.state <> 'removed' AND s.state <> v.to_state AND NOT EXISTS (
  SELECT 1 FROM u WHERE u.target = s.key AND (u.type = 'covered_by' OR (u.type = 'fastened_by' AND v.verb IN ('remove', 'open')) OR (u.type = 'connected_to' AND v.verb = 'remove')))""")
def legal_actions(spark, sf_dir):
    current, edges = _graph(spark, sf_dir)
    classes = current.select("cls").distinct()
    verbs = classes.crossJoin(spark.createDataFrame(VERBS, "verb string, to_state string"))  # six classes, three verbs
    return state.legal_actions(current, edges, verbs)


@query("replay_violations", f"""
WITH {GRAPH_SQL}, w AS (SELECT event_id, k, ts FROM a WHERE event_type = 'purchase'),
x AS (SELECT w.event_id AS action_id, g.type, g.blocker, (SELECT arg_max(e.new, (e.ts, e.event_id)) FROM e WHERE e.k = g.blocker AND (e.ts, e.event_id) < (w.ts, w.event_id)) AS st FROM w JOIN g ON g.target = w.k)
SELECT action_id, type, blocker FROM x WHERE NOT (st IS NULL OR st = 'removed' OR (type = 'covered_by' AND st = 'open'))""")
def replay_violations(spark, sf_dir):
    _, edges = _graph(spark, sf_dir)
    log = _events(spark, sf_dir).select(F.col("k").alias("key"), F.col("ts").alias("step"), F.col("event_id").alias("seq"), F.col("new").alias("state"))
    done = table(spark, sf_dir, "events").where("event_type = 'purchase' and value >= 2")
    actions = done.select(F.col("event_id").alias("action_id"), F.floor(F.col("event_id") / 20).alias("key"), F.lit("remove").alias("verb"), F.col("ts").alias("step"), F.col("event_id").alias("seq"))
    return state.replay_violations(log, actions, edges)


@query("derive_edges", """
WITH p AS (SELECT DISTINCT l_partkey AS target, l_suppkey AS blocker FROM lineitem WHERE l_quantity > 20),
s AS (SELECT l_partkey AS target, l_suppkey AS blocker, CASE min(l_linenumber) % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'rule' ELSE 'override' END AS source FROM lineitem WHERE l_quantity < 30 GROUP BY 1, 2)
SELECT coalesce(p.target, s.target) AS target, coalesce(p.blocker, s.blocker) AS blocker,
  CASE WHEN source = 'manual' THEN 'manual' WHEN source IS NULL THEN 'fresh' WHEN p.target IS NOT NULL THEN 'kept' WHEN source = 'override' THEN 'orphan' ELSE 'stale' END AS verdict
FROM p FULL JOIN s ON p.target = s.target AND p.blocker = s.blocker""")
def derive_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("blocker"), "l_quantity", "l_linenumber")
    nth = F.min("l_linenumber") % 3
    stored = rows.where("l_quantity < 30").groupBy("target", "blocker").agg(F.when(nth == 0, "manual").when(nth == 1, "rule").otherwise("override").alias("source"))
    return state.derive_edges(rows.where("l_quantity > 20"), stored, ["target", "blocker"])


@query("held_keys", f"""
WITH RECURSIVE {TREE_SQL}, v AS (SELECT k FROM t WHERE k % 3 <> 0), own AS (SELECT k FROM v WHERE k % 50 = 1),
c AS (SELECT k, parent FROM t WHERE parent IS NOT NULL UNION ALL SELECT c.k, t.parent FROM c JOIN t ON t.k = c.parent WHERE t.parent IS NOT NULL)
SELECT k FROM own UNION SELECT c.parent FROM c JOIN own ON own.k = c.k WHERE c.parent % 3 <> 0""")
def held_keys(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    vanished = tree.where("k % 3 <> 0").select("k")
    refs = tree.where("parent is not null").select(F.col("k").alias("source"), F.col("parent").alias("target"))
    return state.held(vanished, vanished.where("k % 50 = 1"), refs, "k")


VIEW_SQL = """
st AS (SELECT o_orderkey AS k, round(o_totalprice) AS value, CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'auto' END AS status FROM orders WHERE o_orderkey % 11 <> 0),
fr AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice) + o_orderkey % 60 ELSE round(o_totalprice) END AS value FROM orders WHERE o_orderkey % 13 <> 0),
ac AS (SELECT coalesce(st.k, fr.k) AS k, st.value AS stored_value, fr.value AS fresh_value, status,
  CASE WHEN st.k IS NULL THEN 'insert' WHEN fr.k IS NULL THEN CASE WHEN status = 'verified' THEN 'queue' ELSE 'delete' END
    WHEN status = 'verified' THEN CASE WHEN abs(st.value - fr.value) > greatest(0.0001 * st.value, 20) THEN 'queue' ELSE 'keep' END WHEN st.value = fr.value THEN 'keep' ELSE 'update' END AS action
  FROM st FULL JOIN fr ON st.k = fr.k)"""


def _refresh(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").alias("value"), F.when(F.col("o_orderstatus") == "F", "verified").otherwise("auto").alias("status"))
    fresh = o.where("k % 13 <> 0").withColumn("value", F.when(F.col("k") % 5 == 0, F.col("value") + F.col("k") % 60).otherwise(F.col("value")))
    far = F.abs(F.col("stored_value") - F.col("fresh_value"))
    return view.refresh_actions(o.where("k % 11 <> 0"), fresh, ["k"], far, F.greatest(0.0001 * F.col("stored_value"), F.lit(20.0)))


@query("refresh_actions", f"WITH {VIEW_SQL} SELECT k, action FROM ac")
def refresh_actions(spark, sf_dir):
    return _refresh(spark, sf_dir).select("k", "action")


@query("refreshed_view", f"WITH {VIEW_SQL} SELECT k, CASE WHEN action IN ('insert', 'update') THEN fresh_value ELSE stored_value END AS value, coalesce(status, 'auto') AS status FROM ac WHERE action <> 'delete'")
def refreshed_view(spark, sf_dir):
    return view.applied(_refresh(spark, sf_dir), ["k"])


@query("new_conflicts", f"WITH {VIEW_SQL} SELECT k, stored_value, fresh_value FROM ac WHERE action = 'queue' AND NOT (k % 2 = 0 AND fresh_value IS NOT NULL)")
def new_conflicts(spark, sf_dir):
    actions = _refresh(spark, sf_dir)
    queue = actions.where("action = 'queue' and k % 2 = 0 and fresh_value is not null").withColumn("status", F.lit("open"))
    return view.new_conflicts(actions, queue, ["k"])


@query("outdated_frames", """
SELECT o_custkey, count(*) AS n_rows FROM orders GROUP BY 1
HAVING NOT (o_custkey % 4 <> 0 AND o_custkey % 7 <> 0)""")
def outdated_frames(spark, sf_dir):
    inputs = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("s")).withColumn("digest", view.digest("o_custkey", "s"))
    stamps = inputs.where("o_custkey % 4 <> 0").withColumn("digest", F.when(F.col("o_custkey") % 7 == 0, "other").otherwise(F.col("digest"))).withColumn("version", F.lit(3))
    return view.outdated(inputs, stamps, ["o_custkey"], 3).select("o_custkey", "n_rows")


@query("recheck_queue", """
WITH q AS (SELECT o_orderkey AS k, 1::BIGINT AS gen FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT coalesce(q.k, a.k) AS k, coalesce(gen, 0) + CASE WHEN a.k IS NULL THEN 0 ELSE 1 END AS gen FROM q FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 0) a ON q.k = a.k)
SELECT k, gen FROM n WHERE NOT gen = 1 OR k % 3 <> 0""")
def recheck_queue(spark, sf_dir):
    k = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    queue = k.where("k % 3 = 0").withColumn("gen", F.lit(1).cast("long"))
    asked = view.request_rechecks(queue, k.where("k % 5 = 0"), ["k"])
    return view.clear_rechecks(asked, queue, ["k"])


@query("frame_status", """
SELECT o_orderkey, CASE WHEN NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) THEN 'missing' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_tax > 0.07) THEN 'conflict' WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'auto' END AS status FROM orders""")
def frame_status(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_tax")
    marks = {"missing": orders.select("o_orderkey").join(lines, "o_orderkey", "left_anti"), "conflict": lines.where("l_tax > 0.07"), "verified": orders.where("o_orderstatus = 'F'")}
    return view.frame_status(orders, ["o_orderkey"], marks, "auto").select("o_orderkey", "status")


@query("upserted", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 4 = 0""")
def upserted(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return view.upsert(rows, rows.where("o_orderkey % 4 = 0").withColumn("o_totalprice", F.lit(-1.0)), ["o_orderkey"])
