"""Entity resolution of step logs: rows name parts, often without numbers; instances are made or reused per machine.

Rows whose identity occurs once on a machine need no history and stay in Spark SQL; only machines' colliding
identities go through the grouped pass.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("remove",)
# Verbs after which a part is still there, the part without an ordinal.
NON_TERMINAL = ["displace", "open", "release", "loosen", "unscrew", "disconnect"]
CHASSIS = "chassis"
NAMES = ["owner", "qualifier", "of"]  #: what else tells parts of one class, kind and number apart


def ledger(rows: DataFrame, machine: str = "machine") -> DataFrame:
    """`rows` (machine, step, seq, cls, disc, number, owner, qualifier, of, verb, ok, gone) with `key`, `made` (the row
    makes the instance) and `rivals` (several instances that an unnumbered removal could mean).

    Windows alone, no search. Of numbered rows of one identity the j-th with a verb operates the j-th instance, because
    each of the earlier ones has had that verb; it makes the instance if no verb came j times before. An unnumbered row
    makes an instance, unless it is a successful removal and exactly one instance of its identity is open: made by an
    unnumbered row that failed, or whose verb leaves the part there (`gone` says that it does not). Open instances never
    get fewer once there are two, so it is enough to look at the row before and whether two were ever open. Ordinals
    count the made instances of a class and kind on a machine; keys are `cls.disc.NN`, `cls.NN`, or `chassis`.
    Rows stand by step, then seq; nulls in names are empty, `ok` and `gone` null are false.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    r = rows.withColumns({f"_{c}": said(c) for c in ("cls", "disc", *NAMES)})
    group, names = [machine, "_cls", "_disc"], [machine, "_cls", "_disc", *[f"_{c}" for c in NAMES]]
    at = ["step", "seq"]
    w = lambda *by: Window.partitionBy(*by).orderBy(*at)
    earlier = lambda *by: w(*by).rowsBetween(Window.unboundedPreceding, -1)

    n = r.where("number is not null").withColumn("_j", F.row_number().over(w(*names, "number", "verb")))
    n = n.withColumn("made", F.coalesce(F.max("_j").over(earlier(*names, "number")), F.lit(0)) < F.col("_j"))
    n = n.withColumn("_mine", F.struct(F.col("_j").cast("long").alias("a"), F.lit(0).cast("long").alias("b"))).drop("_j").withColumn("rivals", F.lit(False))

    ok = F.coalesce(F.col("ok"), F.lit(False))
    removes = ok & F.col("verb").isin(*TERMINAL)
    opens = ~F.coalesce(F.col("gone"), F.lit(False)) & (~ok | F.col("verb").isin(NON_TERMINAL))
    u = r.where("number is null").withColumn("_kind", F.when(removes, "R").when(opens, "O").otherwise("X"))
    place = F.struct(F.col("step").cast("long").alias("a"), F.col("seq").cast("long").alias("b"))
    told = u.withColumn("_told", F.col("_kind") != "X")
    before = F.lag(F.struct("_kind", place.alias("p"))).over(w(*names, "_told"))
    told = told.withColumn("_before", F.when(F.col("_told"), before))
    two = F.coalesce((F.col("_kind") == "O") & (F.col("_before._kind") == "O"), F.lit(False))
    told = told.withColumn("_two", F.coalesce(F.max(two.cast("int")).over(earlier(*names, "_told")), F.lit(0)) > 0)
    reuse = F.coalesce((F.col("_kind") == "R") & (F.col("_before._kind") == "O") & ~F.col("_two"), F.lit(False))
    u = told.withColumn("made", ~reuse).withColumn("_mine", F.when(reuse, F.col("_before.p")).otherwise(place))
    u = u.withColumn("rivals", (F.col("_kind") == "R") & F.col("_two")).drop("_kind", "_told", "_before", "_two")

    every = n.unionByName(u)
    every = every.withColumn("_nth", F.sum(F.col("made").cast("int")).over(w(*group)))
    own = F.first(F.when(F.col("made"), F.col("_nth")), ignorenulls=True).over(Window.partitionBy(*names, "number", "_mine"))
    every = every.withColumn("_ordinal", own)
    kind = F.when(F.col("_disc") != "", F.concat(F.lit("."), "_disc")).otherwise("")
    digits = F.col("_ordinal").cast("string")
    key = F.when(F.col("_cls") == CHASSIS, CHASSIS).otherwise(F.concat("_cls", kind, F.lit("."), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)))
    return every.withColumn("key", key).select(*rows.columns, "key", "made", "rivals")


def step_type(step: Column, hint: Column, attempt: Column, multi: Column) -> Column:
    """initial, a marker's hint, failed, compound or normal: the first that holds."""
    return F.when(step == 1, "initial").when(hint.isNotNull(), hint).when(attempt, "failed").when(multi, "compound").otherwise("normal")


def resolve(rows: DataFrame, machine: str = "desktop", step: str = "step", cls: str = "cls", number: str = "number", verb: str = "verb", ok: str = "ok") -> DataFrame:
    """`rows` with `key`: `class.NN` on its machine.

    A numbered row takes the instance of its number unless the verb was already done to it; an unnumbered successful
    removal takes the only instance that is not removed; everything else makes a new instance. Rows are read in order,
    however many machines a partition has.
    """
    n = F.count("*").over(Window.partitionBy(machine, cls))
    marked = rows.withColumn("_n", n)
    single = marked.where("_n = 1").drop("_n").withColumn("key", F.concat(F.col(cls), F.lit(".01")))

    def run(batches):
        group = None
        for b in batches:
            keys = []
            for m, c, num, done, good in zip(*[b.column(x).to_pylist() for x in (machine, cls, number, verb, ok)]):
                if group != (m, c):
                    group, numbered, alive, n_made = (m, c), {}, {}, 0
                found = None
                if num is not None:
                    found = next((i for i in numbered.get(int(num), []) if done not in i["done"]), None)
                elif good and done in TERMINAL:
                    found = next(iter(alive.values())) if len(alive) == 1 else None
                if found is None:
                    n_made += 1
                    found = alive[n_made] = {"done": set(), "ordinal": n_made}
                    if num is not None:
                        numbered.setdefault(int(num), []).append(found)
                if good:
                    found["done"].add(done)
                    if done in TERMINAL:
                        alive.pop(found["ordinal"], None)
                keys.append(f"{c}.{found['ordinal']:02d}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.string())], names=[*b.schema.names, "key"])

    many = marked.where("_n > 1").drop("_n")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in many.schema.fields)
    ordered = many.repartition(machine, cls).sortWithinPartitions(machine, cls, F.col(step).asc_nulls_last())
    return single.unionByName(ordered.mapInArrow(run, f"{kinds}, key string"))
