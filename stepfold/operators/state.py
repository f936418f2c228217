"""State machine and constraint graph: effects, cascades, legality, replay, reconciliation of derived edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.session import cut, vocabulary

# Edge types, the blocker states that satisfy each, and the verbs that each gates.
REQUIRED_STATES = {
    "fastened_by": ["loosened", "removed"],
    "connected_to": ["unplugged", "removed"],
    "locked_by": ["open"],
    "covered_by": ["open", "removed", "displaced"],
    "blocked_by": ["removed", "displaced", "released"],
}
GATED_VERBS = ["remove", "displace", "open", "unscrew", "disconnect", "release"]
GATES = {
    "fastened_by": ["remove", "displace", "open"],
    "locked_by": ["remove", "displace", "open"],
    "covered_by": GATED_VERBS,
    "connected_to": ["remove"],
}
INACTIVE = ["rejected", "accepted_orphan", "rejected_orphan"]  # statuses of edges that gate nothing
BLOCKED_GATES = {"cable_tension": ["remove"], "physical_path": ["remove", "displace"], "tool_access": GATED_VERBS}


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def gated_verbs(edge_type: Column, mode: Column) -> Column:
    """Verbs that an edge gates; all of them for an unknown type and for `blocked_by` of unknown mode."""
    table = [F.when(edge_type == t, _strings(v)) for t, v in GATES.items()] + [F.when((edge_type == "blocked_by") & (mode == m), _strings(v)) for m, v in BLOCKED_GATES.items()]
    return F.coalesce(*table, _strings(GATED_VERBS))


def satisfied(edge_type: Column, state: Column) -> Column:
    """A missing blocker and a removed one satisfy every edge, else the type's states do."""
    known = F.coalesce(*[F.when(edge_type == t, state.isin(s)) for t, s in REQUIRED_STATES.items()], F.lit(False))
    return state.isNull() | (state == "removed") | known


def events_from_actions(actions: DataFrame, effects: DataFrame, by: list[str], order: list[str], verb: str, succeeded: Column, default: str) -> DataFrame:
    """State changes (old, new) of successful actions whose verb has an effect (verb, new) that is not yet the case."""
    done = actions.where(succeeded).join(vocabulary(effects), verb)
    old = F.coalesce(F.lag("new").over(Window.partitionBy(*by).orderBy(*order)), F.lit(default))
    return done.withColumn("old", old).where("old <> new")


def closure(links: DataFrame, parent: str, child: str, max_rounds: int = 40) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a link table, by path doubling; a cycle's pairs appear once."""
    pairs = cut(links.select(F.col(parent).alias("ancestor"), F.col(child).alias("descendant"), F.lit(1).cast("long").alias("distance")).where("ancestor <> descendant").distinct())
    n = pairs.count()
    for _ in range(max_rounds):
        a, b = pairs.alias("a"), pairs.alias("b")
        longer = a.join(b, F.col("a.descendant") == F.col("b.ancestor")).select(F.col("a.ancestor"), F.col("b.descendant"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        pairs = cut(pairs.union(longer).where("ancestor <> descendant").groupBy("ancestor", "descendant").agg(F.min("distance").alias("distance")))
        more = pairs.count()
        if more == n:
            return pairs
        n = more
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def cycles(links: DataFrame, parent: str, child: str) -> DataFrame:
    """Nodes that are their own ancestor through others."""
    pairs = closure(links, parent, child)
    a, b = pairs.alias("a"), pairs.alias("b")
    return a.join(b, (F.col("a.ancestor") == F.col("b.descendant")) & (F.col("a.descendant") == F.col("b.ancestor"))).select(F.col("a.ancestor").alias("node")).distinct()


def removal_cascade(instances: DataFrame, removed: DataFrame, key: str, parent: str, attached: Column, takes_along: Column) -> DataFrame:
    """(key, gone_at, left_with): an instance goes at its own removal, or earlier with an ancestor it hangs on.

    Links hold from attached children to parents and have no cycle (see `cycles`); only ancestors that satisfy
    `takes_along` claim, and only what had not left before. `removed`: (key, step) of own removals. The earliest claim
    wins, ties by ancestor. Every node carries its earliest claim and a pointer that doubles its reach each round, so
    rows stay as many as instances and rounds grow with the logarithm of the depth.
    """
    own = removed.select(F.col(key).alias("k"), F.col("step").alias("own"))
    nodes = instances.select(F.col(key).alias("k"), F.when(attached, F.col(parent)).alias("up"), takes_along.alias("takes")).join(own, "k", "left")
    claims = nodes.where("takes and own is not null").select(F.col("k").alias("up"), F.struct(F.col("own").alias("at"), F.col("k").alias("ancestor")).alias("claim"))
    state = cut(nodes.join(claims, "up", "left").select("k", "own", "up", "claim"))
    for _ in range(64):
        if state.where("up is not null").limit(1).count() == 0:
            break
        above = state.select(F.col("k").alias("up"), F.col("up").alias("next"), F.col("claim").alias("higher"))
        state = cut(state.join(above, "up", "left").select("k", "own", F.col("next").alias("up"), F.least("claim", "higher").alias("claim")))
    else:
        raise RuntimeError("the links have a cycle")
    claimed = F.col("claim").isNotNull() & (F.col("own").isNull() | (F.col("own") >= F.col("claim.at")))
    gone = F.when(claimed, F.col("claim.at")).otherwise(F.col("own"))
    return state.select(F.col("k").alias(key), gone.alias("gone_at"), F.when(claimed, F.col("claim.ancestor")).alias("left_with")).where("gone_at is not null")


def unmet(edges: DataFrame, state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Active edges (by, target, type, mode, blocker, status) whose blocker's state (by, key, state) does not satisfy them.

    `by` names what keys are unique in, such as the machine; without it keys must be unique in the whole table.
    """
    active = edges.where(~F.col("status").isin(INACTIVE))
    joined = active.join(state.select(*by, F.col("key").alias("blocker"), F.col("state").alias("blocker_state")), [*by, "blocker"], "left")
    return joined.where(~satisfied(F.col("type"), F.col("blocker_state")))


def stopped(edges: DataFrame, state: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, verb) that an unmet edge gates."""
    return unmet(edges, state, by).select(*by, F.col("target").alias("key"), F.explode(gated_verbs(F.col("type"), F.col("mode"))).alias("verb"))


def legal_actions(state: DataFrame, edges: DataFrame, verbs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, verb) that apply in a state and that no unmet edge gates.

    state: (by, key, cls, state); verbs: (verb, cls, to_state), the vocabulary: a removed part takes no verb, nor does one
    that is already in the verb's state. For `by` see `unmet`.
    """
    possible = state.join(vocabulary(verbs), "cls").where("state <> 'removed' and state <> to_state").select(*by, "key", "verb")
    return possible.join(stopped(edges, state, by), [*by, "key", "verb"], "left_anti")


def replay_violations(events: DataFrame, actions: DataFrame, edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Successful actions with an unmet edge in the state just before them: (action_id, type, blocker).

    events: (by, key, step, seq, state); actions: (action_id, by, key, verb, step, seq). The blocker's state before an
    action is the last event of smaller (step, seq): both logs are stacked and swept once for each blocker. For `by` see
    `unmet`.
    """
    gates = edges.where(~F.col("status").isin(INACTIVE)).withColumn("verb", F.explode(gated_verbs(F.col("type"), F.col("mode")))).withColumnRenamed("target", "key")
    asked = actions.join(gates.select(*by, "key", "verb", "type", "blocker"), [*by, "key", "verb"]).select("action_id", *by, F.col("blocker").alias("key"), "type", "step", "seq", F.lit(None).cast("string").alias("state"))
    log = events.select(F.lit(None).cast(actions.schema["action_id"].dataType).alias("action_id"), *by, "key", F.lit(None).cast("string").alias("type"), "step", "seq", "state")
    before = Window.partitionBy(*by, "key").orderBy("step", "seq", F.col("action_id").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    swept = asked.union(log).withColumn("was", F.last("state", ignorenulls=True).over(before)).where("action_id is not null")
    return swept.where(~satisfied(F.col("type"), F.col("was"))).select("action_id", "type", F.col("key").alias("blocker"))


def validate_events(events: DataFrame, by: list[str], order: list[str], known: list[str]) -> DataFrame:
    """Events whose `old` is not the value before, or whose `new` is no known state."""
    w = Window.partitionBy(*by).orderBy(*order)
    issue = F.when(~F.col("new").isin(known), "unknown state").when(F.lag("new").over(w).isNotNull() & (F.lag("new").over(w) != F.col("old")), "wrong old")
    return events.withColumn("issue", issue).where("issue is not null")


def derive_edges(proposed: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """One verdict for each edge: stored rows have a `source` (rule, override, manual).

    fresh: proposed and not stored; kept: both; stale: a rule edge no longer proposed; orphan: a human decision about
    such an edge; manual edges always stay.
    """
    p = proposed.select(*keys, F.lit(True).alias("_p")).distinct()
    both = p.join(stored.select(*keys, "source"), keys, "full_outer")
    verdict = F.when(F.col("source") == "manual", "manual").when(F.col("source").isNull(), "fresh").when(F.col("_p"), "kept").when(F.col("source") == "override", "orphan").otherwise("stale")
    return both.withColumn("verdict", verdict).select(*keys, "verdict")


def held(vanished: DataFrame, working: DataFrame, references: DataFrame, key: str) -> DataFrame:
    """Vanished keys that must stay: those with work, and all that they name (source, target), transitively."""
    own = vanished.join(working.select(key).distinct(), key, "left_semi")
    among = references.select("source", "target").distinct()
    reach = closure(among, "source", "target").select(F.col("ancestor").alias(key), F.col("descendant").alias("named"))
    named = reach.join(own, key).select(F.col("named").alias(key)).join(vanished, key, "left_semi")
    return own.select(key).union(named).distinct()
