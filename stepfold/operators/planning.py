"""Plans over the constraint graph as joins: an AND/OR search of facts and actions, and plans that are certainly wrong.

A fact is a part in a state. An action (key, verb, from) leads from one fact of its part to another once each of its
conditions has a fact that meets it: the part is in the state it starts from, and for each edge that gates the verb the
blocker is in one of the states that satisfy the edge. All machines, goals and necessities are searched at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.operators.derivation import constraint_edges
from stepfold.operators.state import INACTIVE, REQUIRED_STATES, gated_verbs
from stepfold.session import cut, tasks_for, vocabulary

# Verbs from the least destructive on, and the necessity that is a preference only.
VERB_PREFERENCE = ["open", "release", "unscrew", "disconnect", "displace", "remove"]
RECOMMENDED = "recommended"
LEAVES = "leaves"  #: what an attached part does when its parent is removed; no step of a plan


def preference(verb: Column) -> Column:
    return F.array_position(F.array(*[F.lit(v) for v in VERB_PREFERENCE]), verb)


def accepted_states(edge_type: Column) -> Column:
    """The blocker states that satisfy an edge; a removed blocker satisfies all."""
    table = [F.when(edge_type == t, F.array_union(F.array(*[F.lit(x) for x in s]), F.array(F.lit("removed")))) for t, s in REQUIRED_STATES.items()]
    return F.coalesce(*table, F.array(F.lit("removed")))


def possible_actions(state: DataFrame, verbs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, key, verb, from, to) of all parts; verbs: (verb, cls, from, to), the vocabulary. A removed part takes none."""
    return state.select(*by, "key", "cls").join(vocabulary(verbs), "cls").where("from <> 'removed' and from <> to").select(*by, "key", "verb", "from", "to")


def conditions(actions: DataFrame, edges: DataFrame, state: DataFrame, attached: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """(by, key, verb, from, to, edge, soft, part, state): one row for each fact that meets a condition of an action, rows
    may repeat.

    `edge` names the condition: empty for the state the part starts from; `soft`: of a preference only. Edges of blockers
    without a state are met and left out. attached: (by, key, parent); such a part leaves when its parent is removed.
    """
    firm = F.lit(False).alias("soft")
    own = actions.select("*", F.lit("").alias("edge"), firm, F.col("key").alias("part"), F.col("from").alias("state"))
    known = state.select(*by, F.col("key").alias("blocker"))
    gates = constraint_edges(edges).where(~F.col("status").isin(INACTIVE)).join(known, [*by, "blocker"], "left_semi")
    soft = F.col("necessity").eqNullSafe(RECOMMENDED).alias("soft")
    gates = gates.select(*by, F.col("target").alias("key"), F.explode(gated_verbs(F.col("type"), F.col("mode"))).alias("verb"), F.concat_ws(" ", "type", "blocker").alias("edge"), soft, F.col("blocker").alias("part"), F.explode(accepted_states(F.col("type"))).alias("state"))
    out = own.unionByName(actions.join(gates, [*by, "key", "verb"]))
    if attached is not None:
        gone = attached.select(*by, "key", F.lit(LEAVES).alias("verb"), F.lit("any").alias("from"), F.lit("removed").alias("to"), F.lit("").alias("edge"), firm, F.col("parent").alias("part"), F.lit("removed").alias("state"))
        out = out.unionByName(gone)
    return out


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """`rows`, kept, with a number each."""
    return cut(rows.withColumn(name, F.monotonically_increasing_id()))


def both_kinds(rows: DataFrame, *numbers: str) -> DataFrame:
    """`rows` twice, for the strict and the `relaxed` search; the numbers of either are apart, the relaxed ones odd."""
    twice = rows.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("relaxed"))
    return twice.withColumns({c: F.col(c) * 2 + F.col("relaxed").cast("long") for c in numbers})


def reachable(waits: DataFrame, gives: DataFrame, start: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(f, level, a): the facts that can be brought about, with each action that does so first. All are numbers: action a
    waits for its n edges e, each of which any of its facts f meets (waits: a, e, f), and gives a fact (gives: a, n, gives).

    Level 0 is what is the case (start: f), without an action. A fact's level is the round in which an action that leads to
    it has all conditions met; an action that has is looked at no more. Rounds are as many as the longest chain of waiting
    actions.
    """
    found = fresh = cut(start.select("f", F.lit(0).alias("level"), F.lit(None).cast("long").alias("a")))
    open_ = gives.select("a", "n", "gives", F.array().cast("array<int>").alias("es"))
    for level in range(1, max_rounds):
        touched = waits.join(fresh.select("f").distinct(), "f").groupBy("a").agg(F.collect_set("e").alias("es"))
        both = open_.unionByName(touched, allowMissingColumns=True).groupBy("a")
        met = cut(both.agg(F.max("n").alias("n"), F.max("gives").alias("gives"), F.array_distinct(F.flatten(F.collect_list("es"))).alias("es")).where("n is not null"))
        ready = met.where(F.size("es") == F.col("n")).select(F.col("gives").alias("f"), F.lit(level).alias("level"), "a")
        fresh = cut(ready.join(found.select("f").distinct(), "f", "left_anti"))
        if not fresh.take(1):
            return found
        found, open_ = found.union(fresh), met.where(F.size("es") < F.col("n"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def plan_steps(needs: DataFrame, state: DataFrame, goals: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, relaxed, goal, step, key, verb, from, to): for each goal (by, goal, part) that can be removed, what has to be
    done, in order, once with the `soft` conditions and once without; needs: as `conditions` gives them.

    Names are shuffled a few times only: facts and actions get numbers, which the rounds go over. Of several actions that
    bring a fact about in its round the least destructive verb is kept. From the goal's fact back to what is the case: each
    needed fact brings its action, and each condition of that the fact of the lowest level that meets it. Steps stand by
    level, so whatever an action waits for comes before it. Goals that are removed already, or never can be, have no rows.
    """
    fact, action = [*by, "part", "state"], [*by, "key", "verb", "from", "to"]
    condition = F.struct("edge", "soft", "part", "state")
    gathered = needs.groupBy(*action).agg(F.collect_set(condition).alias("c"))
    edges = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: x["edge"])))
    actions = numbered(gathered.select("*", edges(F.col("c")).alias("edges"), F.size(edges(F.filter("c", lambda x: ~x["soft"]))).alias("firm")), "a")
    waits = actions.select(*by, "a", "edges", F.explode("c").alias("c")).select(*by, "a", F.array_position("edges", F.col("c.edge")).alias("e"), "c.soft", "c.part", "c.state")
    now, made = state.select(*by, F.col("key").alias("part"), "state"), actions.select(*by, F.col("key").alias("part"), F.col("to").alias("state"), "a", "edges", "firm", "verb", "from")
    # numbers of the facts of one group ascend by part and state, which decides between equal ones
    facts = waits.select(*fact).union(made.select(*fact)).union(now).distinct().repartition(*by).sortWithinPartitions(*fact)
    facts = numbered(facts, "f")
    known = both_kinds(facts.join(now, fact, "left_semi").select("f"), "f")
    made = made.join(facts, fact).select("a", F.size("edges").alias("n"), "firm", F.col("f").alias("gives"), "verb", "from")
    waits = cut(both_kinds(waits.join(facts, fact).select("a", "e", "soft", "f"), "a", "f").where("not (relaxed and soft)").select("a", F.col("e").cast("int").alias("e"), "f"))
    gives = both_kinds(made.select("a", "n", "firm", "gives"), "a", "gives").select("a", F.when(F.col("relaxed"), F.col("firm")).otherwise(F.col("n")).alias("n"), "gives")
    found = reachable(waits, gives, known)
    best = F.min(F.struct(preference(F.col("verb")).alias("p"), "verb", "from", "a")).alias("best")
    made = cut(found.where("level > 0").join(both_kinds(made.select("a", "verb", "from"), "a").drop("relaxed"), "a").groupBy("f", "level").agg(best).select("f", "level", "best.*"))
    found = known.select("f", F.lit(0).alias("level"), F.lit(None).cast("int").alias("p")).unionByName(made.select("f", "level", "p"))
    options = waits.join(made.select("a", F.col("f").alias("_k"), F.col("level").alias("at")), "a").join(found, "f")
    chosen = options.where("level < at").groupBy("_k", "e").agg(F.min(F.struct("level", "p", "f")).alias("c"))
    chosen = cut(chosen.select("_k", "c.f").distinct())
    todo = goals.select(*by, "goal", "part", F.lit("removed").alias("state")).join(facts, fact).select("goal", "f").distinct()
    needed = fresh = cut(both_kinds(todo, "f").select("goal", "f").join(made, "f", "left_semi"))
    while fresh.take(1):
        wider = fresh.withColumnRenamed("f", "_k").join(chosen, "_k").select("goal", "f").distinct()
        fresh = cut(wider.join(needed, ["goal", "f"], "left_anti"))
        needed = cut(needed.unionByName(fresh))
    named = made.where(F.col("verb") != LEAVES).select("f", "level", "verb", "from", F.expr("f % 2 = 1").alias("relaxed"), F.expr("f div 2").alias("_f"))
    named = named.join(facts.withColumnRenamed("f", "_f"), "_f").drop("_f")
    done = needed.join(named, "f").drop("f")
    by = [*by, "relaxed"]
    # a part that is needed in several states goes through them in order: from the one before where the verb starts from
    # that too; once it is removed, which satisfies every edge, it is not touched again
    order = ["level", preference(F.col("verb")), "part", "state"]
    own = Window.partitionBy(*by, "goal", "part").orderBy(*order)
    gone = F.max((F.col("state") == "removed").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    done = done.withColumn("_gone", gone).where("_gone is null or _gone = 0").withColumn("_was", F.lag("state").over(own))
    starts = actions.select(*by[:-1], F.col("key").alias("part"), "verb", F.col("from").alias("_was"), F.col("to").alias("state"), F.lit(True).alias("_starts"))
    done = done.join(starts, [*by[:-1], "part", "verb", "_was", "state"], "left").withColumn("from", F.when(F.col("_starts"), F.col("_was")).otherwise(F.col("from")))
    step = F.row_number().over(Window.partitionBy(*by, "goal").orderBy(*order)) - 1
    return done.select(*by, "goal", step.alias("step"), F.col("part").alias("key"), "verb", "from", F.col("state").alias("to"))


def removal_plans(state: DataFrame, edges: DataFrame, verbs: DataFrame, goals: DataFrame, by: Sequence[str], attached: DataFrame | None = None) -> DataFrame:
    """(by, goal, relaxed, step, key, verb, from, to): a plan with verbs for each goal (by, goal) that can be removed.

    state: (by, key, cls, state); edges: (by, target, type, blocker, mode, necessity, status); verbs: (verb, cls, from,
    to). Recommended edges hold where that leaves a plan; else the plan of the required ones alone is given, `relaxed`.
    An attached part, which only leaves with its parent, is planned as its parent's removal.
    """
    needs = cut(conditions(possible_actions(state, verbs, by), edges, state, attached, by))
    steps = cut(plan_steps(needs, state, goals.select(*by, "goal", F.col("goal").alias("part")), by))
    strict = steps.where("not relaxed").select(*by, "goal").distinct()
    return steps.where("not relaxed").unionByName(steps.where("relaxed").join(strict, [*by, "goal"], "left_anti"))


# --- plans that are certainly wrong ------------------------------------------------------------------------------


def unsound(steps: DataFrame, state: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, goal) of plans that a replay refuses: a step does not start from what its part is then, or a required edge
    is not satisfied; or the last step does not remove the goal or a part that takes it along."""
    plans = steps.withColumnRenamed("step", "pos")
    broken = simulated(plans.select(*by, "goal", "pos", "key", "verb", "to"), state, edges, [*by, "goal"], by).select(*by, "goal")
    before = F.lag("to").over(Window.partitionBy(*by, "goal", "key").orderBy("pos"))
    chained = plans.withColumn("_b", before).join(state.select(*by, "key", F.col("state").alias("_s")), [*by, "key"], "left")
    odd = chained.where(~F.coalesce("_b", "_s").eqNullSafe(F.col("from"))).select(*by, "goal")
    ends = plans.groupBy(*by, "goal").agg(F.max_by("to", "pos").alias("_t")).where("_t <> 'removed'").select(*by, "goal")
    return reduce(DataFrame.union, [broken, odd, ends]).distinct()


def rearranged(rows: DataFrame, n: str) -> DataFrame:
    """`rows` once for each way to swap two neighbours of a log of `n` actions or to move one by two places or more, as
    (tag, family, _j, _i): what stood at place _j comes to place _i."""
    spots = F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    ways = rows.withColumn("_j", spots).withColumn("_i", spots).where("_i = _j + 1 or abs(_i - _j) >= 2")
    swap = F.col("_i") == F.col("_j") + 1
    tag = F.when(swap, F.concat(F.lit("swap"), "_j")).otherwise(F.concat(F.lit("move"), "_j", F.lit("to"), "_i"))
    return ways.withColumn("tag", tag).withColumn("family", F.when(swap, "swap").otherwise("move"))


def there(p: Column) -> Column:
    """Where what stood at place `p` stands then."""
    i, j = F.col("_i"), F.col("_j")
    return F.when(p == j, i).when((j < p) & (p <= i), p - 1).when((i <= p) & (p < j), p + 1).otherwise(p)


def rearrangements(logs: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, tag, family, pos, key, verb, to): each log (by, pos from 0, key, verb, to) rearranged in every way."""
    every = rearranged(logs.withColumn("_n", F.count("*").over(Window.partitionBy(*by))), "_n")
    return every.select(*by, "tag", "family", there(F.col("pos")).alias("pos"), "key", "verb", "to")


def simulated(plans: DataFrame, state: DataFrame, edges: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(plan, pos, broken): the positions at which a required edge is not satisfied, with the edges' labels, sorted.

    plans: (on, by, pos, key, verb, to), `on` naming a plan and `by`, part of it or not, what keys are unique in. What a
    blocker's state is before a position is the last earlier action's on it, else the state at the start: actions and
    questions are stacked and swept once for each plan and part, whatever the number of plans.
    """
    keep = list(dict.fromkeys([*on, *by]))
    asked = questions(plans, state, edges, by).select(*keep, F.col("blocker").alias("part"), "pos", "type", F.col("key").alias("target"), "_start", F.lit(None).cast("string").alias("to"))
    made = plans.select(*keep, F.col("key").alias("part"), "pos", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("_start"), "to")
    before = Window.partitionBy(*keep, "part").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1)
    was = F.coalesce(F.last("to", ignorenulls=True).over(before), "_start")
    swept = asked.unionByName(made).withColumn("_was", was).where("type is not null")
    bad = swept.where(~F.array_contains(accepted_states(F.col("type")), F.col("_was")))
    return bad.groupBy(*keep, "pos").agg(F.array_sort(F.collect_set(edge_label("type", "target", "part"))).alias("broken"))


def questions(plans: DataFrame, state: DataFrame, edges: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each action of `plans` with each required edge that gates it: type, blocker and `_start`, the blocker's state at the
    start. Blockers without a state satisfy all and are left out."""
    gates = constraint_edges(edges).where(~F.col("status").isin(INACTIVE) & ~F.coalesce(F.col("necessity") == RECOMMENDED, F.lit(False)))
    gates = gates.select(*by, F.col("target").alias("key"), F.explode(gated_verbs(F.col("type"), F.col("mode"))).alias("verb"), "type", "blocker")
    start = state.select(*by, F.col("key").alias("blocker"), F.col("state").alias("_start"))
    return plans.join(gates, [*by, "key", "verb"]).join(start, [*by, "blocker"])


def edge_label(kind: str, target: str, blocker: str) -> Column:
    return F.concat(F.col(kind), F.lit("("), target, F.lit(", "), blocker, F.lit(")"))


def certain_corruptions(logs: DataFrame, state: DataFrame, edges: DataFrame, on: Sequence[str], by: Sequence[str]) -> DataFrame:
    """(on, tag, family, first_error, broken, corrupted): of each log one rearrangement that violates a required edge.

    logs: (on, by, pos, key, verb, to) from position 0. All rearrangements of all logs are simulated at once; those that
    break nothing are plans of unknown validity and never given, and of the others the first in the order of
    md5(on | tag) is. A log that does not itself hold, or that no rearrangement breaks, gives nothing. `corrupted` is
    the wrong plan as `verb key` strings. No rearranged log is written out: each question of a log is put together with the
    actions on its blocker, dealt to tasks by log, and only there asked once for each rearrangement.
    """
    keep = list(dict.fromkeys([*on, *by]))
    sound = logs.join(simulated(logs, state, edges, on, by).select(*keep).distinct(), keep, "left_anti")
    sound = cut(sound.withColumn("_n", F.count("*").over(Window.partitionBy(*keep))))
    acts = sound.where("to is not null").groupBy(*keep, F.col("key").alias("blocker")).agg(F.collect_list(F.struct("pos", "to")).alias("_acts"))
    asked = questions(sound, state, edges, by).join(acts, [*keep, "blocker"], "left").select(*keep, "_n", "pos", "type", "key", "blocker", "_start", "_acts")
    every = rearranged(asked.repartition(tasks_for(sound), *keep), "_n").withColumn("_at", there(F.col("pos")))
    before = F.filter(F.transform("_acts", lambda a: F.struct(there(a["pos"]).alias("pos"), a["to"].alias("to"))), lambda a: a["pos"] < F.col("_at"))
    was = F.coalesce(F.array_max(before)["to"], "_start")
    wrong = every.where(~F.array_contains(accepted_states(F.col("type")), was))
    told = wrong.groupBy(*keep, "tag", "family", "_i", "_j").agg(F.min("_at").alias("first_error"), F.collect_set(F.struct(F.col("_at").alias("pos"), edge_label("type", "key", "blocker").alias("label"))).alias("_b"))
    broken = F.array_sort(F.transform(F.filter("_b", lambda x: x["pos"] == F.col("first_error")), lambda x: x["label"]))
    seed = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in on], "tag"))
    first = F.min_by(F.struct("tag", "family", "first_error", broken.alias("broken"), "_i", "_j"), F.struct(seed.alias("h"), "tag"))
    picked = told.groupBy(*keep).agg(first.alias("p")).select(*keep, "p.*")
    said = F.transform(F.array_sort(F.collect_list(F.struct(there(F.col("pos")).alias("pos"), F.concat_ws(" ", "verb", "key").alias("a")))), lambda s: s["a"])
    named = picked.join(sound.select(*keep, "pos", "key", "verb"), keep)
    return named.groupBy(*keep, "tag", "family", "first_error", "broken").agg(said.alias("corrupted"))
