"""Queries over ordered logs: folds, as-of joins, segments, gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepfold.operators import joins, windows
from stepfold.plans.registry import query
from stepfold.plans.tables import ENTITY, ORDER, table

CUTOFF = "2024-01-20 00:00:00"


@query(
    "state_snapshot",
    f"""
SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, max(ts) AS since
FROM events WHERE ts <= TIMESTAMP '{CUTOFF}' AND value IS NOT NULL GROUP BY user_id, event_type""",
)
def state_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(ENTITY, "event_type", *ORDER, "value")
    return windows.snapshot(events, [ENTITY, "event_type"], ORDER, "value", F.col("ts") <= F.lit(CUTOFF).cast("timestamp_ntz"))


@query(
    "state_fold",
    """
SELECT event_id, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS current
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN value END AS p FROM events)""",
)
def state_fold(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("p"))
    return windows.state_fold(events, [ENTITY], ORDER, "p").select("event_id", "current")


@query(
    "change_events",
    """
SELECT event_id, old, event_type AS new FROM (
  SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events) WHERE old IS DISTINCT FROM event_type""",
)
def change_events(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type")
    return windows.change_events(events, [ENTITY], ORDER, "event_type").select("event_id", "old", "new")


@query(
    "merge_logs",
    """
SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY day, source, event_id) AS position FROM (
  SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS source FROM events)""",
)
def merge_logs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, F.to_date("ts").alias("day"), "event_type")
    derived, manual = (events.where(f"event_type {op} 'error'").drop("event_type") for op in ("<>", "="))
    return windows.merge_logs(derived, manual, [ENTITY], "day", "event_id").select("event_id", "position")


@query(
    "asof_forward",
    """
SELECT l.event_id, coalesce(arg_min(v.event_id, v.ts), -1) AS version, arg_min(v.value, v.ts) AS version_value
FROM (SELECT * FROM events WHERE event_type = 'view') l LEFT JOIN (
  SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'click' GROUP BY user_id, ts
) v ON l.user_id = v.user_id AND v.ts >= l.ts GROUP BY l.event_id""",
)
def asof_forward(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type", "value")
    left = events.where("event_type = 'view'").select("event_id", ENTITY, "ts")
    versions = events.where("event_type = 'click'").select("event_id", ENTITY, "ts", "value")
    found = joins.forward_asof(left, versions, [ENTITY], "ts", "ts", [F.col("event_id").desc()])
    return found.select("event_id", F.coalesce("version.event_id", F.lit(-1).cast("long")).alias("version"), F.col("version.value").alias("version_value"))


@query(
    "asof_backward",
    """
SELECT l.event_id, coalesce(arg_max(v.event_id, v.ts), -1) AS version
FROM (SELECT * FROM events WHERE event_type = 'purchase') l LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v
ON l.user_id = v.user_id AND v.ts <= l.ts GROUP BY l.event_id""",
)
def asof_backward(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type")
    left, versions = (events.where(f"event_type = '{t}'").drop("event_type") for t in ("purchase", "view"))
    found = joins.backward_asof(left, versions, [ENTITY], "ts", "ts", [F.col("event_id").desc()])
    return found.select("event_id", F.coalesce("version.event_id", F.lit(-1).cast("long")).alias("version"))


@query(
    "asof_inverse",
    """
SELECT version AS event_id, count(*) AS n, min(ts) AS first, max(ts) AS last FROM (
  SELECT l.event_id, l.ts, arg_min(v.event_id, v.ts) AS version
  FROM (SELECT * FROM events WHERE event_type = 'view') l JOIN (SELECT * FROM events WHERE event_type = 'click') v
  ON l.user_id = v.user_id AND v.ts >= l.ts GROUP BY l.event_id, l.ts) GROUP BY version""",
)
def asof_inverse(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type")
    left, versions = (events.where(f"event_type = '{t}'").drop("event_type") for t in ("view", "click"))
    return joins.inverse_asof(left.drop("event_id"), versions, [ENTITY], "ts", "ts", [F.col("event_id").desc()], "event_id")


@query(
    "durations",
    """
WITH s AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_type FROM events),
k AS (SELECT * FROM s WHERE event_type <> 'signup')
SELECT a.user_id, a.step, CASE WHEN a.ts >= b.ts THEN (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 END AS duration_s,
  coalesce((epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 > 43200, false) AS long_gap
FROM k a LEFT JOIN k b ON a.user_id = b.user_id AND b.step = a.step - 1""",
)
def durations(spark, sf_dir):
    steps = windows.ordinals(table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type"), [ENTITY], ORDER, "step")
    kept = steps.where("event_type <> 'signup'").select(ENTITY, "step", "ts")
    return windows.durations(kept, [ENTITY], "step", "ts", 43200.0).drop("ts")


@query(
    "sequence_issues",
    """
SELECT event_id, k, CASE WHEN nth > 1 THEN 'duplicate' ELSE 'gap' END AS issue FROM (
  SELECT event_id, k, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS nth,
    max(k) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)) WHERE nth > 1 OR k > most + 1""",
)
def sequence_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return windows.sequence_issues(rows, [ENTITY], ORDER, "k").select("event_id", "k", "issue")


@query(
    "repeated_operations",
    """SELECT event_id, nth FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS nth FROM events) WHERE nth > 1""",
)
def repeated_operations(spark, sf_dir):
    return windows.repeated_operations(table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type"), [ENTITY], "event_type", ORDER).select("event_id", "nth")


@query(
    "islands",
    """
WITH d AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m FROM orders),
r AS (SELECT *, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS run FROM d)
SELECT o_custkey, min(m) AS first, max(m) AS last, count(*) AS n FROM r GROUP BY o_custkey, run""",
)
def islands(spark, sf_dir):
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("m")
    return windows.islands(table(spark, sf_dir, "orders").select("o_custkey", month), ["o_custkey"], "m")


@query(
    "compact_runs",
    """
WITH d AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS m FROM orders),
r AS (SELECT *, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS run FROM d),
i AS (SELECT o_custkey, min(m) AS a, max(m) AS b, count(*) AS n FROM r GROUP BY o_custkey, run)
SELECT o_custkey, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) || ' (n=' || sum(n)::BIGINT || ')' AS runs FROM i GROUP BY o_custkey""",
)
def compact_runs(spark, sf_dir):
    return windows.compact_runs(islands(spark, sf_dir), ["o_custkey"])


SEGMENTS_SQL = """
n AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS last FROM orders GROUP BY o_custkey),
b AS (SELECT o_custkey, last, CAST(x AS BIGINT) AS b FROM n, (VALUES (1), (4), (7), (30)) v(x) WHERE x = 1 OR (x > 1 AND x <= last)),
s AS (SELECT o_custkey, row_number() OVER w AS seg, b AS start, coalesce(lead(b) OVER w - 1, last) AS "end" FROM b WINDOW w AS (PARTITION BY o_custkey ORDER BY b)),
b2 AS (SELECT o_custkey, last, CAST(x AS BIGINT) AS b FROM n, (VALUES (1), (4), (9)) v(x) WHERE x = 1 OR (x > 1 AND x <= last)),
s2 AS (SELECT o_custkey, row_number() OVER w AS seg, b AS start, coalesce(lead(b) OVER w - 1, last) AS "end" FROM b2 WINDOW w AS (PARTITION BY o_custkey ORDER BY b))
"""


def _segments(spark, sf_dir, bounds):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("last"))
    marks = n.withColumn("b", F.explode(F.array(*[F.lit(b).cast("long") for b in bounds])))
    return windows.segments(marks, ["o_custkey"], "b", "last")


@query("segments", f'WITH {SEGMENTS_SQL} SELECT o_custkey, seg, start, "end" FROM s')
def segments(spark, sf_dir):
    return _segments(spark, sf_dir, (4, 7, 30))


@query(
    "recut_affected",
    f"""WITH {SEGMENTS_SQL}, c AS ((SELECT * FROM s EXCEPT SELECT * FROM s2) UNION (SELECT * FROM s2 EXCEPT SELECT * FROM s))
SELECT DISTINCT o_custkey, unnest(range(start, "end" + 1)) AS step FROM c""",
)
def recut_affected(spark, sf_dir):
    return windows.affected_steps(_segments(spark, sf_dir, (4, 7, 30)), _segments(spark, sf_dir, (4, 9)), ["o_custkey"])


@query(
    "interval_lookup",
    f"""WITH {SEGMENTS_SQL}, o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step, o_orderstatus FROM orders)
SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 99 END, (SELECT min(seg) FROM s WHERE s.o_custkey = o.o_custkey AND s.start <= o.step AND s."end" >= o.step AND s.seg <> 2), 0) AS segment FROM o""",
)
def interval_lookup(spark, sf_dir):
    orders = windows.ordinals(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "step")
    ranges = _segments(spark, sf_dir, (4, 7, 30)).where("seg <> 2")
    own = F.when(F.col("o_orderstatus") == "P", F.lit(99).cast("long"))
    return joins.interval_lookup(orders, ranges, ["o_custkey"], "step", "start", "end", "seg", own, F.lit(0).cast("long")).select("o_orderkey", "segment")


@query(
    "straddling",
    """
WITH a AS (SELECT DISTINCT o_custkey, CAST(dayofyear(o_orderdate) AS BIGINT) AS anchor FROM orders),
p AS (SELECT *, coalesce(lag(anchor) OVER (PARTITION BY o_custkey ORDER BY anchor), 0) AS previous FROM a)
SELECT o_custkey, anchor, previous, CAST(182 AS BIGINT) AS boundary FROM p WHERE previous + 1 < 182 AND 182 <= anchor""",
)
def straddling(spark, sf_dir):
    anchors = table(spark, sf_dir, "orders").select("o_custkey", F.dayofyear("o_orderdate").cast("long").alias("anchor")).distinct()
    return joins.straddling(anchors, ["o_custkey"], "anchor", F.lit(182).cast("long")).select("o_custkey", "anchor", F.col("previous").cast("long").alias("previous"), "boundary")


@query(
    "reordered",
    """
SELECT o_orderkey, actual, stated FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS actual,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS stated FROM orders) WHERE actual <> stated""",
)
def reordered(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return windows.reordered(orders, ["o_custkey"], ["o_orderkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "actual", "stated")


@query(
    "next_purchase",
    """
SELECT event_id, coalesce(first_value(p IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_purchase
FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS p FROM events)""",
)
def next_purchase(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type")
    wanted = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return windows.next_present(events, [ENTITY], ORDER, wanted, "next_purchase").select("event_id", F.coalesce("next_purchase", F.lit(-1).cast("long")).alias("next_purchase"))


@query(
    "progress_bins",
    """
SELECT event_id, done, total, CAST(least(floor(done / total * 4), 3) AS BIGINT) AS bin FROM (
  SELECT event_id, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS done,
    count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS total FROM events) WHERE total > 0""",
)
def progress_bins(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type")
    return windows.progress_bins(events, [ENTITY], ORDER, F.col("event_type") == "purchase").select("event_id", "done", "total", "bin")


@query("balanced_pairs")
def balanced_pairs(spark, sf_dir):
    """All non-purchases of a user above the mean of 10, and as many others by hash rank (DuckDB has no crc32)."""
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "value")
    return windows.balanced(events, [ENTITY], F.col("value") > 10, F.col("event_id").cast("string"), "V12")


@query(
    "evenly_spaced",
    """
WITH p AS (SELECT event_id, row_number() OVER w - 1 AS a, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id FROM p WHERE n <= 5 OR a = 0 OR floor(a * 5 / n) <> floor((a - 1) * 5 / n)""",
)
def evenly_spaced(spark, sf_dir):
    return windows.evenly_spaced(table(spark, sf_dir, "events").select("event_id", ENTITY, "ts"), [ENTITY], ORDER, 5).select("event_id")


@query(
    "epochs",
    """
WITH r AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS epoch FROM events)
SELECT user_id, epoch, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, epoch""",
)
def epochs(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type")
    return windows.epochs(events, [ENTITY], ORDER, F.col("event_type") == "error")


@query(
    "adjacent_diff",
    """
SELECT a.conv_id, a.turn, b.role AS old, a.role AS new FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE a.role IS DISTINCT FROM b.role""",
)
def adjacent_diff(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("old"))
    return turns.join(before, ["conv_id", "turn"]).where(~F.col("role").eqNullSafe(F.col("old"))).select("conv_id", "turn", "old", F.col("role").alias("new"))


@query(
    "missing_cells",
    """
WITH r AS (SELECT DISTINCT conv_id, turn, role FROM conversations), n AS (SELECT conv_id, max(turn) AS n FROM conversations GROUP BY conv_id),
e AS (SELECT conv_id, unnest(range(0, n + 1)) AS turn FROM n)
SELECT e.conv_id, e.turn, v.role FROM e, (VALUES ('user'), ('assistant')) v(role) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.conv_id = e.conv_id AND r.turn = e.turn AND r.role = v.role)""",
)
def missing_cells(spark, sf_dir):
    return joins.missing_cells(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", ["user", "assistant"])


@query(
    "beyond_tolerance",
    """
SELECT o_orderkey, abs(epoch_us(first_ship) - epoch_us(o_orderdate)) / 1e6 AS off_s FROM orders JOIN (SELECT l_orderkey AS o_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY 1) USING (o_orderkey)
WHERE abs(epoch_us(first_ship) - epoch_us(o_orderdate)) / 1e6 > 2592000""",
)
def beyond_tolerance(spark, sf_dir):
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("first_ship"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return joins.beyond_tolerance(orders, ship, ["o_orderkey"], "first_ship", "o_orderdate", 2592000.0).select("o_orderkey", "off_s")


@query(
    "reconcile",
    """
WITH d AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0),
o AS (SELECT l_orderkey AS k, max(l_linestatus) AS v FROM lineitem GROUP BY 1)
SELECT coalesce(d.k, o.k) AS k, d.v AS declared, o.v AS observed,
  CASE WHEN o.k IS NULL THEN 'missing' WHEN d.k IS NULL THEN 'extra' ELSE 'differs' END AS verdict
FROM d FULL JOIN o ON d.k = o.k WHERE d.k IS NULL OR o.k IS NULL OR d.v IS DISTINCT FROM o.v""",
)
def reconcile(spark, sf_dir):
    declared = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    observed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("v"))
    return joins.reconcile(declared, observed, ["k"], "v")


@query(
    "join_with_fix",
    """
SELECT o_orderkey, coalesce(c.c_nationkey, f.n, -9) AS c_nationkey, CASE WHEN c.c_nationkey IS NOT NULL THEN 'seen' WHEN f.n IS NOT NULL THEN 'fix' ELSE 'none' END AS origin
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) c ON o_custkey = c_custkey
LEFT JOIN (SELECT c_custkey AS k, -1 AS n FROM customer WHERE c_custkey % 10 = 0) f ON o_custkey = f.k""",
)
def join_with_fix(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    fixes = customers.where("c_custkey % 10 = 0").select("c_custkey", F.lit(-1).alias("c_nationkey"))
    return joins.join_with_fix(orders, customers.where("c_custkey % 5 <> 0"), "c_custkey", "c_nationkey", fixes).drop("c_custkey").fillna(-9, ["c_nationkey"])


@query(
    "unique_of_class",
    """SELECT p_brand, p_size, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_size HAVING count(*) = 1""",
)
def unique_of_class(spark, sf_dir):
    return joins.unique_of_class(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey"), ["p_brand", "p_size"], "p_partkey")


@query(
    "band_candidates",
    """
WITH e AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT event_id, candidate, rank FROM (
  SELECT l.event_id, r.event_id AS candidate, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.step - r.step), r.value DESC, r.event_id) AS rank
  FROM e l JOIN e r ON l.user_id = r.user_id AND abs(l.step - r.step) <= 4 WHERE l.event_type = 'purchase' AND r.event_type = 'click') WHERE rank <= 3""",
)
def band_candidates(spark, sf_dir):
    e = windows.ordinals(table(spark, sf_dir, "events").select("event_id", ENTITY, "ts", "event_type", "value"), [ENTITY], ORDER, "step")
    left = e.where("event_type = 'purchase'").select("event_id", ENTITY, "step")
    right = e.where("event_type = 'click'").select(ENTITY, F.col("event_id").alias("candidate"), F.col("step").alias("at"), "value")
    rank = [F.abs(F.col("step") - F.col("at")), F.col("value").desc(), F.col("candidate")]
    return joins.band_candidates(left, right, [ENTITY], "step", "at", 4, rank, 3).select("event_id", "candidate", "rank")


@query("orphans", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def orphans(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return joins.orphans(lines, table(spark, sf_dir, "part").where("p_size > 10"), "l_partkey", "p_partkey").select("l_orderkey", "l_partkey")
