"""Question generators that need the constraint graph or pairs of answers, and what rules a machine out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.operators.state import stopped
from stepfold.session import vocabulary

# Labels that show a part well enough to be asked about, and the two causes of a certain no.
ANSWERABLE = ["visible", "visible_tiny", "occluded_partial"]
GRAPH, STATE = "blocked_by_graph", "inapplicable"


def seeded(*parts: Column) -> Column:
    """The hash that orders and picks: crc32 of the parts joined by `|`."""
    return F.crc32(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def pick(templates: list[str], record_id: Column) -> Column:
    """One wording for a record, always the same."""
    index = F.pmod(seeded(record_id), F.lit(len(templates)))
    return F.element_at(F.array(*[F.lit(t) for t in templates]), (index + 1).cast("int"))


def pointable(rows: DataFrame, verified_only: bool = False) -> DataFrame:
    """Rows that can be pointed at: an answerable label, a known class and a box."""
    ok = F.col("visibility").isin(ANSWERABLE) & F.col("cls").isNotNull() & F.col("x0").isNotNull()
    return rows.where(ok & (F.col("status") == "verified") if verified_only else ok)


def certain_noes(state: DataFrame, edges: DataFrame, verbs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, verb, cause): actions that are certainly impossible in a state; keys are unique within `by`.

    verbs: (verb, cls, to_state). The graph blocks an action that would apply; the state rules out a verb of the class
    that has happened already or comes too late.
    """
    every = state.join(vocabulary(verbs), "cls")
    applies = (F.col("state") != "removed") & (F.col("state") != F.col("to_state"))
    gated = stopped(edges, state, by).distinct()
    graph = every.where(applies).join(gated, [*by, "key", "verb"], "left_semi").select(*by, "key", "verb", F.lit(GRAPH).alias("cause"))
    return graph.union(every.where(~applies).select(*by, "key", "verb", F.lit(STATE)))


def matched_noes(demonstrated: DataFrame, noes: DataFrame, by: list[str], spoken: DataFrame) -> DataFrame:
    """For each demonstrated action (by, verb, cls) the certain no (by, verb, cls, key, cause) closest to it.

    Same verb and class, then same verb, then same class, then any; then verbs that are used at all; the graph before
    the state; ties in hash order. The best no of each verb and class is found first, so that a demonstrated action meets
    four rows of its machine, not all of its noes.
    """
    used = noes.join(spoken.select("verb").distinct().withColumn("_used", F.lit(True)), "verb", "left")
    rank = F.struct(F.col("_used").isNull().alias("unspoken"), (F.col("cause") != GRAPH).alias("state"), seeded(*[F.col(c) for c in by], F.col("verb"), F.col("key")).alias("h"), "verb", "key", "cause")
    each = used.groupBy(*by, "verb", "cls").agg(F.min(rank).alias("r"))
    found = demonstrated.select(*by, "verb", "cls").distinct()
    tiers = (["verb", "cls"], ["verb"], ["cls"], [])
    for n, like in enumerate(tiers):
        found = found.join(each.groupBy(*by, *like).agg(F.min("r").alias(f"_r{n}")), [*by, *like], "left")
    no = F.coalesce(*[F.col(f"_r{n}") for n in range(len(tiers))])
    tier = F.coalesce(*[F.when(F.col(f"_r{n}").isNotNull(), n) for n in range(len(tiers))])
    return found.where("_r3 is not null").select(*by, F.col("verb").alias("shown_verb"), no["verb"].alias("verb"), no["key"].alias("key"), no["cause"].alias("cause"), tier.alias("tier"))


def bounded_sets(demonstrated: DataFrame, permitted: DataFrame, noes: DataFrame, by: list[str]) -> DataFrame:
    """(by, must_include, must_not_include, permitted): what was done, what certainly cannot be, all that nothing forbids.

    Moments whose demonstrated action the graph would forbid say nothing and are left out.
    """
    action = F.concat_ws(":", "verb", "key")
    listed = lambda df, out: df.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(action)), ",").alias(out))
    sure = demonstrated.join(permitted.select(*by, "verb", "key"), [*by, "verb", "key"], "left_semi")
    out = listed(sure, "must_include").join(listed(noes, "must_not_include"), by, "left").join(listed(permitted, "permitted"), by)
    return out.withColumn("must_not_include", F.coalesce("must_not_include", F.lit("")))


def answerable_pairs(rows: DataFrame, by: list[str], name: str, budget: int) -> DataFrame:
    """As many parts that cannot be seen as parts that can, of each frame, `budget` of either at most, in hash order."""
    seen = F.col("visibility").isin(ANSWERABLE)
    w = Window.partitionBy(*by)
    take = F.least(F.count_if(seen).over(w), F.count_if(~seen).over(w), F.lit(budget))
    marked = rows.withColumn("answerable", seen).withColumn("_take", take)
    rank = F.row_number().over(Window.partitionBy(*by, "answerable").orderBy(seeded(*[F.col(c) for c in by], F.col(name)), name))
    return marked.withColumn("_r", rank).where("_r <= _take").drop("_r", "_take")


def referring(rows: DataFrame, by: list[str], name: str, budget: int) -> DataFrame:
    """(by, name, phrase, family) of `budget` parts of each frame, in hash order, that one expression singles out.

    The class alone where it is the only one, else class and state, else class and place in reading order if the class
    has two; parts that no expression singles out are not asked for.
    """
    of = lambda *c: F.count("*").over(Window.partitionBy(*by, *c))
    left = F.row_number().over(Window.partitionBy(*by, "cls").orderBy("x0", name)) == 1
    phrase = F.when(of("cls") == 1, F.struct(F.concat(F.lit("the "), "cls").alias("phrase"), F.lit("class").alias("family"))).when(of("cls", "state") == 1, F.struct(F.concat(F.lit("the "), "state", F.lit(" "), "cls").alias("phrase"), F.lit("state").alias("family"))).when(of("cls") == 2, F.struct(F.concat(F.lit("the "), F.when(left, "left").otherwise("right"), F.lit(" "), "cls").alias("phrase"), F.lit("place").alias("family")))
    order = Window.partitionBy(*by).orderBy(seeded(*[F.col(c) for c in by], F.col(name)), name)
    ranked = rows.withColumn("_p", phrase).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget)
    return ranked.where("_p is not null").select(*by, name, "_p.phrase", "_p.family")


def fastened_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, role, n): screws of each role that are still fastened."""
    return rows.where("cls = 'screw' and state = 'tight'").groupBy(*by, "role").agg(F.count("*").alias("n"))


def exclusion_reasons(machines: DataFrame, versions: DataFrame, edges: DataFrame, deadlocked: DataFrame, key: str) -> DataFrame:
    """(key, reason) of machines whose graph cannot be trusted: no version, no edges, or a deadlock; the first that holds."""
    mark = lambda df, out: df.select(key).distinct().withColumn(out, F.lit(True))
    both = machines.select(key).join(mark(versions, "_v"), key, "left").join(mark(edges, "_e"), key, "left").join(mark(deadlocked, "_d"), key, "left")
    reason = F.when(F.col("_v").isNull(), "no_graph_version").when(F.col("_e").isNull(), "no_constraint_edges").when(F.col("_d"), "deadlock")
    return both.select(key, reason.alias("reason")).where("reason is not null")


def corruptions(sequences: DataFrame, by: list[str], place: str, action: str, length: int) -> DataFrame:
    """The last `length` actions of each log, and the same with two neighbours swapped, the first swap in hash order.

    No edge is asked, so the swapped log may well be a plan that works: `planning.certain_corruptions` gives those that
    cannot. This one is for pairs of sequences that differ, not for pairs of right and wrong."""
    back = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(place).desc()))
    last = sequences.withColumn("_b", back).where(F.col("_b") <= length)
    g = last.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col(action).alias("a")))), lambda s: s["a"]).alias("logged"))  # `length` rows
    g = g.where(F.size("logged") >= 2)
    spots = F.filter(F.sequence(F.lit(0), F.size("logged") - 2), lambda i: F.get("logged", i) != F.get("logged", i + 1))
    ranked = F.array_min(F.transform(spots, lambda i: F.struct(seeded(*[F.col(c) for c in by], i).alias("h"), i.alias("i"))))["i"]
    swapped = F.transform("logged", lambda a, j: F.when(j == F.col("_i"), F.get("logged", j + 1)).when(j == F.col("_i") + 1, F.get("logged", j - 1)).otherwise(a))
    return g.withColumn("_i", ranked).where("_i is not null").withColumn("corrupted", swapped).drop("_i")
