"""Queries of the derived constraint graph with a state on each of many machines, whose keys are equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepfold.operators import derivation as D
from stepfold.operators import questions as Q
from stepfold.operators import planning as P
from stepfold.operators import records as V
from stepfold.operators import state as S
from stepfold.plans.derivations import EDGES_SQL, instances
from stepfold.plans.registry import query

BY = ["machine"]
#: what a hand does to a part of each class, and the state that leaves it in
DONE = {"screw": ("unscrew", "loosened"), "connector": ("disconnect", "unplugged"), "ram_latch": ("open", "open"), "cpu_socket_lever": ("open", "open"), "cover": ("displace", "displaced")}
CLASSES = ["psu", "cpu", "cpu_cooler", "motherboard", "cpu_socket_lever", "screw", "connector", "ram_latch", "cover", "ram_module", "storage_drive"]
VERBS = [("remove", c, "removed") for c in CLASSES] + [(v, c, s) for c, (v, s) in DONE.items()]
OPENED_SQL = "CASE cls " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, (_, s) in DONE.items()) + " ELSE 'installed' END"
STATUS = {0: "rejected", 1: "accepted_orphan", 2: "accepted"}

STATE_SQL = f"""{EDGES_SQL},
n AS (SELECT machine, key, cls, CAST(right(key, 2) AS INTEGER) AS n FROM r),
s AS (SELECT machine, key, cls, n, CASE (n + machine) % 4 WHEN 0 THEN 'removed' WHEN 1 THEN {OPENED_SQL} ELSE 'installed' END AS state FROM n),
a AS (SELECT machine, type, target, blocker FROM p WHERE (CAST(right(blocker, 2) AS INTEGER) + CAST(right(target, 2) AS INTEGER)) % 6 NOT IN (0, 1))"""
MET_SQL = "({0} IS NULL OR {0} = 'removed' OR (type = 'fastened_by' AND {0} = 'loosened') OR (type = 'connected_to' AND {0} = 'unplugged') OR (type = 'locked_by' AND {0} = 'open') OR (type = 'covered_by' AND {0} IN ('open', 'displaced')))"
GRAPH_SQL = f"""{STATE_SQL},
un AS (SELECT a.* FROM a LEFT JOIN s ON s.machine = a.machine AND s.key = a.blocker WHERE NOT {MET_SQL.format("s.state")}),
v AS (SELECT * FROM (VALUES {", ".join(f"('{v}', '{c}', '{s}')" for v, c, s in VERBS)}) x(verb, cls, to_state)),
g AS (SELECT machine, target AS key, unnest(CASE type WHEN 'covered_by' THEN ['remove', 'displace', 'open', 'unscrew', 'disconnect', 'release'] WHEN 'connected_to' THEN ['remove'] ELSE ['remove', 'displace', 'open'] END) AS verb FROM un),
y AS (SELECT s.machine, s.key, v.verb, s.state <> 'removed' AND s.state <> to_state AS applies, EXISTS (SELECT 1 FROM g WHERE g.machine = s.machine AND g.key = s.key AND g.verb = v.verb) AS stopped FROM s JOIN v USING (cls))"""


def number(key: str):
    return F.right(key, F.lit(2)).cast("int")


def graph(spark, sf_dir):
    """(state, edges) of all machines: a quarter of the parts gone, a quarter loosened, opened or unplugged."""
    own = instances(spark, sf_dir)
    opened = F.coalesce(*[F.when(F.col("cls") == c, s) for c, (_, s) in DONE.items()], F.lit("installed"))
    turn = (number("key") + F.col("machine")) % 4
    state = D.settled(own).select("machine", "key", "cls", F.when(turn == 0, "removed").when(turn == 1, opened).otherwise("installed").alias("state"))
    nth = (number("blocker") + number("target")) % 6
    status = F.coalesce(*[F.when(nth == k, v) for k, v in STATUS.items()], F.lit("proposed"))
    edges = D.propose_edges(own).select("machine", "type", "target", "blocker", F.lit(None).cast("string").alias("mode"), status.alias("status"))
    return P.cut(state), P.cut(edges)


def verbs(spark):
    return spark.createDataFrame(VERBS, "verb string, cls string, to_state string")


@query("machine_unmet_edges", f"WITH {GRAPH_SQL} SELECT machine, type, target, blocker FROM un")
def machine_unmet_edges(spark, sf_dir):
    state, edges = graph(spark, sf_dir)
    return S.unmet(edges, state, BY).select("machine", "type", "target", "blocker")


@query("machine_legal_actions", f"WITH {GRAPH_SQL} SELECT machine, key, verb FROM y WHERE applies AND NOT stopped")
def machine_legal_actions(spark, sf_dir):
    """What may be done on each machine, with the edges that its own parts imply and its own state."""
    state, edges = graph(spark, sf_dir)
    return S.legal_actions(state, edges, verbs(spark), BY)


@query("machine_certain_noes", f"WITH {GRAPH_SQL} SELECT machine, key, verb, CASE WHEN applies THEN 'blocked_by_graph' ELSE 'inapplicable' END AS cause FROM y WHERE NOT applies OR stopped")
def machine_certain_noes(spark, sf_dir):
    state, edges = graph(spark, sf_dir)
    return Q.certain_noes(state, edges, verbs(spark), BY)


@query("machine_replay_violations", f"""
WITH {STATE_SQL}, l AS (SELECT machine, key, (n * 7 + machine) % 50 AS step, n AS seq, state FROM s WHERE state <> 'installed'),
x AS (SELECT l.machine, l.key, a.type, a.blocker, (SELECT arg_max(b.state, (b.step, b.seq)) FROM l b WHERE b.machine = l.machine AND b.key = a.blocker AND (b.step, b.seq) < (l.step, l.seq)) AS st
  FROM l JOIN a ON a.machine = l.machine AND a.target = l.key WHERE l.state = 'removed'),
w AS (SELECT *, coalesce(st, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.machine = x.machine AND s.key = x.blocker) THEN 'installed' END) AS was FROM x)
SELECT machine || '/' || key AS action_id, type, blocker FROM w WHERE NOT {MET_SQL.format("was")}""")
def machine_replay_violations(spark, sf_dir):
    """Removals that came too early: each machine's log against its own edges."""
    state, edges = graph(spark, sf_dir)
    at = [((number("key") * 7 + F.col("machine")) % 50).alias("step"), number("key").alias("seq")]
    log = state.where("state <> 'installed'").select("machine", "key", *at, "state")
    start = state.select("machine", "key", F.lit(-1).cast("long").alias("step"), F.lit(-1).alias("seq"), F.lit("installed").alias("state"))
    done = log.where("state = 'removed'").select(F.concat_ws("/", "machine", "key").alias("action_id"), "machine", "key", F.lit("remove").alias("verb"), "step", "seq")
    return S.replay_violations(start.unionByName(log), done, edges, BY)


START = {"screw": "fastened", "connector": "plugged", "ram_latch": "closed", "cpu_socket_lever": "closed"}
PLAIN = [c for c in CLASSES if c not in START]
#: what a part of each class lets be done, and from where to where; latches and levers stay in the machine
STEPS = [
    ("unscrew", "screw", "fastened", "loosened"), ("remove", "screw", "loosened", "removed"),
    ("disconnect", "connector", "plugged", "unplugged"), ("remove", "connector", "plugged", "removed"), ("remove", "connector", "unplugged", "removed"),
    *[(v, c, "closed", "open") for v in ("open", "release") for c in ("ram_latch", "cpu_socket_lever")],
    *[x for c in PLAIN for x in (("displace", c, "installed", "displaced"), ("remove", c, "installed", "removed"), ("remove", c, "displaced", "removed"))],
]
GOALS = ["psu", "cpu", "cpu_cooler", "motherboard", "ram_module", "storage_drive"]
START_SQL = "CASE cls " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in START.items()) + " ELSE 'installed' END"
NUMBER_SQL = "CAST(right({}, 2) AS INTEGER)"
VERB_PLANS_SQL = f"""{EDGES_SQL},
s AS MATERIALIZED (SELECT machine, key, cls, CASE WHEN ({NUMBER_SQL.format("key")} + machine) % 5 = 0 THEN {OPENED_SQL} ELSE {START_SQL} END AS state FROM r),
b AS (SELECT machine, 'blocked_by' AS type, a.key AS target, b.key AS blocker FROM r a JOIN r b USING (machine) WHERE {NUMBER_SQL.format("a.key")} % 10 IN (3, 7) AND {NUMBER_SQL.format("b.key")} = {NUMBER_SQL.format("a.key")} + CASE {NUMBER_SQL.format("a.key")} % 10 WHEN 3 THEN 2 ELSE -2 END),
h AS (SELECT machine, type, target, blocker FROM p UNION ALL SELECT * FROM b),
ed AS MATERIALIZED (SELECT *, ({NUMBER_SQL.format("blocker")} + {NUMBER_SQL.format("target")}) % 4 = 0 AS soft, CASE type WHEN 'fastened_by' THEN ['loosened', 'removed'] WHEN 'connected_to' THEN ['unplugged', 'removed'] WHEN 'locked_by' THEN ['open', 'removed'] WHEN 'covered_by' THEN ['open', 'removed', 'displaced'] ELSE ['removed', 'displaced', 'released'] END AS fine,
  CASE WHEN type IN ('fastened_by', 'locked_by') THEN ['remove', 'displace', 'open'] WHEN type = 'connected_to' THEN ['remove'] WHEN type = 'blocked_by' THEN ['remove', 'displace'] ELSE ['remove', 'displace', 'open', 'unscrew', 'disconnect', 'release'] END AS gated FROM h)"""


def plan_graph(spark, sf_dir):
    """(state, edges): the derived edges and some that a person added, a quarter of all preferences only."""
    own = instances(spark, sf_dir)
    rows = D.settled(own).select("machine", "key", "cls")
    of = lambda table, rest: F.coalesce(*[F.when(F.col("cls") == c, s) for c, s in table.items()], F.lit(rest))
    done = {c: s for c, (_, s) in DONE.items()}
    state = rows.withColumn("state", F.when((number("key") + F.col("machine")) % 5 == 0, of(done, "installed")).otherwise(of(START, "installed")))
    at = F.when(number("key") % 10 == 3, number("key") + 2).when(number("key") % 10 == 7, number("key") - 2)
    named = rows.select("machine", F.col("key").alias("blocker"), number("key").alias("at"))
    manual = rows.select("machine", F.col("key").alias("target"), at.alias("at")).join(named, ["machine", "at"]).select("machine", F.lit("blocked_by").alias("type"), "target", "blocker")
    edges = D.propose_edges(own).select("machine", "type", "target", "blocker").unionByName(manual)
    mode = F.when(F.col("type") == "blocked_by", "physical_path")
    necessity = F.when((number("blocker") + number("target")) % 4 == 0, P.RECOMMENDED).otherwise("required")
    return P.cut(state), P.cut(edges.select("*", mode.alias("mode"), necessity.alias("necessity"), F.lit("accepted").alias("status")))


def _facts_sql(rounds: int) -> str:
    """What can be brought about, round by round: an action is done once no gate of it lacks a state that satisfies it."""
    out = """,
va AS (SELECT * FROM (VALUES """ + ", ".join(f"('{v}', '{c}', '{a}', '{b}')" for v, c, a, b in STEPS) + """) x(verb, cls, a, b)),
ac AS MATERIALIZED (SELECT machine, key, verb, a, b FROM s JOIN va USING (cls)),
f0 AS MATERIALIZED (SELECT relaxed, machine, key, state FROM s, (VALUES (false), (true)) x(relaxed))"""
    for k in range(rounds):
        out += f""",
f{k + 1} AS MATERIALIZED (SELECT * FROM f{k} UNION SELECT f.relaxed, ac.machine, ac.key, ac.b FROM ac JOIN f{k} f ON f.machine = ac.machine AND f.key = ac.key AND f.state = ac.a
  WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.machine = ac.machine AND ed.target = ac.key AND list_contains(gated, ac.verb) AND NOT (soft AND f.relaxed) AND target <> blocker
    AND NOT EXISTS (SELECT 1 FROM f{k} o WHERE o.relaxed = f.relaxed AND o.machine = ed.machine AND o.key = ed.blocker AND list_contains(fine, o.state))))"""
    return out


@query("verb_plans", f"""
WITH {VERB_PLANS_SQL}{_facts_sql(14)},
w AS (SELECT DISTINCT relaxed, machine, key FROM f14 WHERE state = 'removed')
SELECT machine, key AS goal, bool_and(relaxed) AS relaxed, true AS sound FROM w JOIN s USING (machine, key) WHERE cls IN ({", ".join(f"'{c}'" for c in GOALS)}) GROUP BY 1, 2""")
def verb_plans(spark, sf_dir):
    """Which parts can be taken out of each machine, with or without its preferences, and that each plan replays."""
    state, edges = plan_graph(spark, sf_dir)
    steps = _verb_plans(spark, state, edges)
    bad = P.unsound(steps, state, edges, BY).select(*BY, "goal", F.lit(True).alias("bad"))
    goals = steps.groupBy(*BY, "goal").agg(F.first("relaxed").alias("relaxed"))
    return goals.join(bad, [*BY, "goal"], "left").select(*BY, "goal", "relaxed", F.col("bad").isNull().alias("sound"))


def _verb_plans(spark, state, edges):
    goals = state.where(F.col("cls").isin(GOALS)).select(*BY, F.col("key").alias("goal"))
    vocabulary = spark.createDataFrame(STEPS, "verb string, cls string, from string, to string")
    return P.removal_plans(state, edges, vocabulary, goals, BY)


@query("verb_plan_steps")
def verb_plan_steps(spark, sf_dir):
    """The plans themselves, step by step (the choice among equal ones is not SQL's; `verb_plans` replays them)."""
    state, edges = plan_graph(spark, sf_dir)
    return _verb_plans(spark, state, edges)


@query("certain_corruptions", f"""
WITH {VERB_PLANS_SQL},
q AS (SELECT machine, key, cls, {START_SQL} AS state FROM r),
d AS (SELECT machine, target AS goal, blocker AS key, any_value(cls) AS cls FROM p JOIN r USING (machine) WHERE r.key = blocker GROUP BY 1, 2, 3),
c AS (SELECT machine, goal, key, CASE cls {" ".join(f"WHEN '{c}' THEN '{v}'" for c, (v, _) in DONE.items())} ELSE 'remove' END AS verb, CASE cls {" ".join(f"WHEN '{c}' THEN '{s}'" for c, (_, s) in DONE.items())} ELSE 'removed' END AS "to" FROM d),
l AS (SELECT machine, goal, list({{'key': key, 'verb': verb, 'to': "to"}} ORDER BY key) || [{{'key': goal, 'verb': 'remove', 'to': 'removed'}}] AS plan FROM c GROUP BY 1, 2),
t AS MATERIALIZED (
  SELECT machine, goal, 'true' AS tag, 'true' AS family, plan FROM l
  UNION ALL SELECT machine, goal, 'swap' || i, 'swap', plan[:i] || [plan[i + 2], plan[i + 1]] || plan[i + 3:] FROM (SELECT *, unnest(range(len(plan) - 1)) AS i FROM l)
  UNION ALL SELECT machine, goal, 'move' || j || 'to' || i, 'move', CASE WHEN i < j THEN plan[:i] || [plan[j + 1]] || plan[i + 1:j] || plan[j + 2:] ELSE plan[:j] || plan[j + 2:i + 1] || [plan[j + 1]] || plan[i + 2:] END
    FROM (SELECT *, unnest(range(len(plan))) AS i FROM (SELECT *, unnest(range(len(plan))) AS j FROM l)) WHERE abs(i - j) >= 2),
un AS MATERIALIZED (SELECT machine, goal, tag, family, pos - 1 AS pos, plan[pos].key AS key, plan[pos].verb AS verb, plan[pos]."to" AS "to" FROM (SELECT *, unnest(range(1, len(plan) + 1)) AS pos FROM t)),
k AS (SELECT un.*, type, blocker, fine FROM un JOIN ed ON ed.machine = un.machine AND ed.target = un.key AND list_contains(gated, un.verb) AND NOT soft AND target <> blocker),
z AS (SELECT k.machine, k.goal, k.tag, k.family, k.pos, type || '(' || k.key || ', ' || blocker || ')' AS label, coalesce(arg_max(b."to", b.pos), any_value(q.state)) AS was, any_value(fine) AS fine
  FROM k JOIN q ON q.machine = k.machine AND q.key = k.blocker LEFT JOIN un b ON b.machine = k.machine AND b.goal = k.goal AND b.tag = k.tag AND b.key = k.blocker AND b.pos < k.pos GROUP BY ALL),
w AS (SELECT machine, goal, tag, family, pos, list(DISTINCT label ORDER BY label) AS broken FROM z WHERE NOT list_contains(fine, was) GROUP BY ALL),
e1 AS (SELECT machine, goal, tag, family, min(pos) AS first_error, arg_min(broken, pos) AS broken FROM w GROUP BY 1, 2, 3, 4),
e2 AS (SELECT *, row_number() OVER (PARTITION BY machine, goal ORDER BY md5(machine || '|' || goal || '|' || tag)) AS nth FROM e1 WHERE tag <> 'true' AND NOT EXISTS (SELECT 1 FROM e1 o WHERE o.machine = e1.machine AND o.goal = e1.goal AND o.tag = 'true'))
SELECT machine, goal, tag, family, first_error, array_to_string(broken, ', ') AS violated, (SELECT string_agg(verb || ' ' || key, ', ' ORDER BY pos) FROM un WHERE un.machine = e2.machine AND un.goal = e2.goal AND un.tag = e2.tag) AS corrupted FROM e2 WHERE nth = 1""")
def certain_corruptions(spark, sf_dir):
    """Of each part's demonstrated removal a rearrangement that violates a required edge, with the edge's name."""
    _, edges = plan_graph(spark, sf_dir)
    rows = D.settled(instances(spark, sf_dir)).select("machine", "key", "cls")
    of = lambda table, rest: F.coalesce(*[F.when(F.col("cls") == c, s) for c, s in table.items()], F.lit(rest))
    start = rows.withColumn("state", of(START, "installed"))
    derived = edges.where("type <> 'blocked_by'").select("machine", F.col("target").alias("goal"), F.col("blocker").alias("key")).distinct()
    first = derived.join(rows, ["machine", "key"]).select("machine", "goal", F.lit(0).alias("part"), "key", of({c: v for c, (v, _) in DONE.items()}, "remove").alias("verb"), of({c: s for c, (_, s) in DONE.items()}, "removed").alias("to"))
    last = derived.select("machine", "goal").distinct().select("machine", "goal", F.lit(1).alias("part"), F.col("goal").alias("key"), F.lit("remove").alias("verb"), F.lit("removed").alias("to"))
    pos = F.row_number().over(Window.partitionBy("machine", "goal").orderBy("part", "key")) - 1
    logs = first.unionByName(last).select("machine", "goal", pos.alias("pos"), "key", "verb", "to")
    out = P.certain_corruptions(logs, start, edges, ["machine", "goal"], BY)
    return out.select("machine", "goal", "tag", "family", "first_error", F.array_join("broken", ", ").alias("violated"), F.array_join("corrupted", ", ").alias("corrupted"))


@query("ordered_edges", f"""
WITH {EDGES_SQL} SELECT machine, type, target, blocker, row_number() OVER (PARTITION BY machine ORDER BY list_position(['fastened_by', 'connected_to', 'locked_by', 'covered_by', 'blocked_by'], type), target, blocker) AS nth FROM p WHERE target <> blocker""")
def ordered_edges(spark, sf_dir):
    """Each machine's constraint edges in the order in which they are shown."""
    edges = D.constraint_edges(D.propose_edges(instances(spark, sf_dir)))
    nth = F.row_number().over(Window.partitionBy("machine").orderBy(*D.edge_order()))
    return edges.select("machine", "type", "target", "blocker", nth.alias("nth"))


CASES_SQL = f"""{GRAPH_SQL},
ok AS (SELECT machine, min(verb || ' ' || key) AS a FROM y WHERE applies AND NOT stopped GROUP BY 1),
no AS (SELECT machine, min(verb || ' ' || key) AS a FROM y WHERE applies AND stopped GROUP BY 1),
st AS (SELECT machine, min(verb || ' ' || key) AS a FROM y WHERE NOT applies GROUP BY 1),
ca AS (SELECT machine, a, 'demonstrated' AS truth FROM ok UNION ALL SELECT machine, a, 'blocked_by_graph' FROM no UNION ALL SELECT machine, a, 'inapplicable' FROM st
  UNION ALL SELECT machine, 'remove ' || key, 'failed_attempt' FROM s WHERE cls = 'ram_module' AND state = 'installed'),
cs AS (SELECT machine, split_part(a, ' ', 1) AS verb, split_part(a, ' ', 2) AS key, truth FROM ca),
bx AS (SELECT machine, key, n, n % 2 = 0 AS sure FROM s WHERE n % 3 <> 0),
un2 AS (SELECT un.*, s.state AS bs FROM un JOIN s ON s.machine = un.machine AND s.key = un.blocker),
ev AS (SELECT DISTINCT cs.machine, cs.verb, cs.key, cs.truth, u.type, u.blocker, u.bs FROM cs JOIN un2 u ON u.machine = cs.machine AND u.target = cs.key
  AND list_contains(CASE u.type WHEN 'covered_by' THEN ['remove', 'displace', 'open', 'unscrew', 'disconnect', 'release'] WHEN 'connected_to' THEN ['remove'] ELSE ['remove', 'displace', 'open'] END, cs.verb) WHERE truth <> 'demonstrated'),
eg AS (SELECT machine, verb, key, truth, list(DISTINCT blocker ORDER BY blocker) AS blockers, string_agg('recall_relation:' || key || ':' || type || ' ' || blocker || ';observe:' || blocker || ':' || bs || ';check_precondition:' || blocker || ':not met', ';' ORDER BY type, blocker) AS said FROM ev GROUP BY 1, 2, 3, 4)"""


@query("feasibility_records", f"""
WITH {CASES_SQL},
f AS (SELECT cs.*, s.state, coalesce(blockers, []) AS blockers, said FROM cs JOIN s USING (machine, key) LEFT JOIN eg USING (machine, verb, key, truth) WHERE truth <> 'failed_attempt' OR said IS NOT NULL),
k AS (SELECT f.machine, f.verb, f.key, f.truth, string_agg(bx.key || ' ' || bx.n, ',' ORDER BY bx.key) AS evidence, bool_and(sure) AS sure FROM f JOIN bx ON bx.machine = f.machine AND (bx.key = f.key OR list_contains(f.blockers, bx.key)) GROUP BY 1, 2, 3, 4)
SELECT 'q_' || substr(sha256('V4|V4-' || machine || '-' || truth || '-' || verb || '-' || key), 1, 16) AS id, machine, 'Can you ' || verb || ' ' || key || ' now?' AS question,
  json_object('feasible', truth = 'demonstrated', 'blockers', blockers, 'reason', CASE WHEN truth = 'demonstrated' THEN NULL WHEN len(blockers) > 0 THEN 'violates_edge' ELSE 'state' END)::VARCHAR AS answer,
  'observe:' || key || ':' || state || coalesce(';' || said, '') || CASE WHEN truth = 'inapplicable' THEN ';check_precondition:' || key || ':not met' ELSE '' END AS chain,
  coalesce(evidence, '') AS evidence, machine % 7 = 0 OR coalesce(sure, false) AS verified, CASE WHEN truth <> 'demonstrated' THEN truth END AS negative, truth
FROM f LEFT JOIN k USING (machine, verb, key, truth)""")
def feasibility_records(spark, sf_dir):
    """A certain yes, a no of either kind and the failed attempts of each machine, as whole records."""
    state, edges = graph(spark, sf_dir)
    action = F.min(F.struct("verb", "key")).alias("a")
    noes = Q.certain_noes(state, edges, verbs(spark), BY)
    first = lambda df, truth: df.groupBy(*BY).agg(action).select(*BY, "a.verb", "a.key", F.lit(truth).alias("truth"))
    tried = state.where("cls = 'ram_module' and state = 'installed'").select(*BY, F.lit("remove").alias("verb"), "key", F.lit(V.FAILED).alias("truth"))
    cases = first(S.legal_actions(state, edges, verbs(spark), BY), V.DEMONSTRATED).unionByName(first(noes.where(F.col("cause") == V.GRAPH), V.GRAPH)).unionByName(first(noes.where(F.col("cause") == V.STATE), V.STATE)).unionByName(tried)
    n = number("key").cast("long")
    boxes = state.where(n % 3 != 0).select(*BY, "key", n.alias("x0"), n.alias("y0"), (n + 5).alias("x1"), (n + 7).alias("y1"), F.lit("visible").alias("visibility"), (n % 2 == 0).alias("verified"))
    frames = state.select(*BY).distinct().withColumn("verified", F.col("machine") % 7 == 0)
    out = V.feasibility(cases, state, edges, boxes, frames, BY, ["Can you {} now?"])
    return out.select("id", "machine", "question", "answer", F.array_join(F.transform("chain", lambda t: F.concat_ws(":", t["op"], t["subject"], t["detail"])), ";").alias("chain"), F.array_join(F.transform("evidence", lambda e: F.concat_ws(" ", e["key"], e["box"][0])), ",").alias("evidence"), "verified", "negative", "truth")
