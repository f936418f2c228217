"""Log import around entity resolution, rankings and tables of the evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.functions.text import merge_notes
from stepfold.session import cut
from stepfold.sources import entities

# The closed set of rationale operations.
CHAIN_OPS = ["observe", "propagate_state", "recall_relation", "check_precondition", "compare_frames", "conclude", "abstain"]

# Step types without an action, default verbs by class, classes that are opened, the machine's own key.
NO_ACTION = ["initial", "dupli", "ignore"]
DEFAULT_VERBS = {"screw": "unscrew", "connector": "disconnect", "cable_clip": "release", "chassis": "reorient"}
OPENED = ["ram_latch", "cpu_socket_lever", "psu_latch", "drive_latch", "card_latch", "cooler_latch", "cover"]
CHASSIS = "chassis"


def sequence_issues(rows: DataFrame, machine: str, step: str, number: str) -> DataFrame:
    """(machine, step, issue) of sheet numbers that are blank, no numbers, repeated, or that skip some.

    A repeat names the first step of its number; a gap is measured from the last number before it that could be read.
    Windows are over the rows of one log.
    """
    said = F.trim(F.coalesce(F.col(number).cast("string"), F.lit("")))
    value = F.try_to_number(F.regexp_extract(said, r"^([+-]?[0-9]+)(\.[0-9]*)?$", 1), F.lit("S999999999999")).cast("long")
    read = rows.select(machine, step, said.alias("_said"), value.alias("_v"))
    order = Window.partitionBy(machine).orderBy(step)
    before = F.last("_v", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.min(step).over(Window.partitionBy(machine, "_v"))
    read = read.withColumn("_before", before).withColumn("_first", first)
    a, b = (F.col("_before") + 1).cast("string"), (F.col("_v") - 1).cast("string")
    issue = (
        F.when(F.col("_said") == "", "blank")
        .when(F.col("_v").isNull(), "not a number")
        .when(F.col("_first") < F.col(step), F.concat(F.lit("repeats step "), F.col("_first").cast("string")))
        .when(F.col("_v") > F.col("_before") + 1, F.concat(F.lit("skips "), F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))))
    )
    return read.select(machine, step, issue.alias("issue")).where("issue is not null")


def repeated_operations(actions: DataFrame, by: list[str], step: str) -> DataFrame:
    """(by, before, step) of operations that succeeded twice on one instance: two parts were taken for one."""
    before = F.lag(step).over(Window.partitionBy(*by).orderBy(step))
    return actions.where(F.col("result") == "success").select(*by, step, before.alias("before")).where("before is not null")


def default_verb(cls: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DEFAULT_VERBS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, cls), F.when(cls.isin(OPENED), "open"), F.lit("remove"))


def import_logs(parsed: DataFrame) -> dict[str, DataFrame]:
    """Parsed log rows (machine, step, raw, cls, number, verb, hint, attempt, multi, tool) as `steps`, `actions`,
    `instances` and `issues`.

    Steps of the types in NO_ACTION have no action. The target is the chassis for it and for turns, a placeholder
    (`class.?` or `?`) with an issue where the row names several parts or no class, else the instance that the row makes
    or finds again. A screw without a known tool gets `unknown` and an issue. Every machine has its chassis.
    """
    kind = F.when(F.coalesce(F.col("hint"), F.lit("")) == "initial", "initial").otherwise(entities.step_type(F.col("step"), F.col("hint"), F.coalesce("attempt", F.lit(False)), F.coalesce("multi", F.lit(False))))
    steps = parsed.withColumn("step_type", kind)
    acts = steps.where(~F.col("step_type").isin(NO_ACTION)).withColumn("cls", F.when(F.col("step_type") == "reorient", CHASSIS).otherwise(F.nullif("cls", F.lit(""))))
    acts = acts.withColumn("verb", F.coalesce("verb", default_verb(F.coalesce("cls", F.lit("")))))
    acts = acts.withColumn("result", F.when(F.col("step_type") == "failed", "failed").otherwise("success")).withColumn("ok", F.col("result") == "success")
    no_tool = (F.col("cls") == "screw") & (F.coalesce("tool", F.lit("none")) == "none")
    acts = acts.withColumn("_no_tool", F.coalesce(no_tool, F.lit(False))).withColumn("tool", F.when(F.col("_no_tool"), "unknown").otherwise(F.coalesce("tool", F.lit("none"))))
    several = (F.col("step_type") == "compound") & (F.coalesce("cls", F.lit("")) != CHASSIS)
    plain = F.when(F.col("cls") == CHASSIS, CHASSIS).when(several, F.concat(F.coalesce(F.concat("cls", F.lit(".")), F.lit("")), F.lit("?"))).when(F.col("cls").isNull(), "?")
    acts = acts.withColumn("key", plain)
    found = cut(entities.resolve(acts.where("key is null").drop("key"), machine="machine"))  # of three tables
    actions = acts.where("key is not null").unionByName(found)
    named = found.groupBy("machine", "key", "cls").agg(F.array_sort(F.collect_list(F.struct("step", "raw")))["raw"].alias("raw_names"))
    chassis = parsed.select("machine").distinct().select("machine", F.lit(CHASSIS).alias("key"), F.lit(CHASSIS).alias("cls"), F.array().cast("array<string>").alias("raw_names"))
    said = F.array_compact(
        F.array(
            F.when(F.col("key").endswith("?") & several, "names several targets"),
            F.when(F.col("key").endswith("?") & ~several, "names no target class"),
            F.when(F.col("_no_tool"), "no tool"),
        )
    )
    return {
        "steps": steps.select("machine", "step", "step_type", "raw"),
        "actions": actions.select("machine", "step", F.lit(0).alias("idx"), F.col("key").alias("target"), "verb", "tool", "result"),
        "instances": named.unionByName(chassis),
        "issues": actions.select("machine", "step", F.explode(said).alias("issue")),
    }


def implied_instances(instances: DataFrame, references: DataFrame, declined: DataFrame, targets: DataFrame | None) -> DataFrame:
    """(machine, cls, key): classes that something refers to and no settled instance has, unless the machine's annotator
    declined them or a logged action (machine, key) already names the key."""
    own = instances.where(~F.col("key").startswith("ls:")).select("machine", "cls")
    out = references.select("machine", "cls").distinct().join(own, ["machine", "cls"], "left_anti").join(declined.select("machine", "cls"), ["machine", "cls"], "left_anti")
    out = out.withColumn("key", F.concat("cls", F.lit(".01")))
    return out if targets is None else out.join(targets.select("machine", "key"), ["machine", "key"], "left_anti")


def carry_notes(steps: DataFrame, previous: DataFrame, keys: list[str], prefix: str) -> tuple[DataFrame, DataFrame]:
    """Steps with the prefixed note line of their previous import, and how many of those lines found no step."""
    line = F.get(F.filter(F.split("notes", "\n"), lambda x: x.startswith(prefix)), 0)
    old = previous.select(*keys, F.trim(F.substr(line, F.lit(len(prefix) + 1))).alias("_line")).where("_line is not null")
    carried = steps.join(old, keys, "left").withColumn("notes", merge_notes(F.col("notes"), F.col("_line"), prefix)).drop("_line")
    return carried, old.join(steps.select(*keys), keys, "left_anti").agg(F.count("*").alias("lost"))


def vocabulary_issues(rows: DataFrame, key: str, verbs: list[str], tools: list[str]) -> DataFrame:
    """(key, issue) of verbs and tools that the vocabulary lacks; a missing tool is none."""
    found = F.array_compact(F.array(F.when(~F.col("verb").isin(verbs), F.lit("unknown verb")), F.when(~F.col("tool").isin(tools), F.lit("unknown tool"))))
    return rows.select(key, F.explode(found).alias("issue"))


def plan_extras(have: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """`n` more instances of each group, numbered on from the largest ordinal there is: (by, ordinal, key)."""
    last = have.groupBy(*by).agg(F.max("ordinal").alias("_last"))
    rows = wanted.join(last, by, "left").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    out = rows.withColumn("ordinal", (F.coalesce("_last", F.lit(0)) + F.col("_i")).cast("long"))
    digits = F.col("ordinal").cast("string")
    return out.select(*by, "ordinal", F.concat_ws(".", *by, F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0"))).alias("key"))


def socket_hosts(rows: DataFrame, instances: DataFrame, named: str) -> DataFrame:
    """`rows` with `host`: what the raw name says after `named`, else the machine's first instance of the wanted class."""
    first = instances.groupBy("machine", F.col("cls").alias("wanted")).agg(F.min_by("key", "place").alias("_first"))
    said = F.nullif(F.regexp_extract("raw", named, 1), F.lit(""))
    return rows.join(first, ["machine", "wanted"], "left").withColumn("host", F.coalesce(said, "_first")).drop("_first")


def short_logs(steps: DataFrame, expected: DataFrame) -> DataFrame:
    """(desktop, expected, found) of logs that have another number of steps than the summary says."""
    found = steps.groupBy("desktop").agg(F.count("*").alias("found"))
    return expected.join(found, "desktop", "left").withColumn("found", F.coalesce("found", F.lit(0))).where("expected <> found")


def ranked(rows: DataFrame, by: list[str], change: str, distance: Column, key: str, eps: float) -> DataFrame:
    """Candidates by change, largest first; those within `eps` of the best go by distance instead."""
    best = F.max(change).over(Window.partitionBy(*by))
    tie = F.col(change) >= best - eps
    marked = rows.withColumn("_tie", tie).withColumn("_d", F.when(tie, distance))
    order = Window.partitionBy(*by).orderBy(~F.col("_tie"), "_d", F.col(change).desc(), key)
    return marked.withColumn("rank", F.row_number().over(order).cast("long")).drop("_tie", "_d")


def frame_hits(truths: DataFrame, matched: DataFrame, frame: list[str], key: str) -> DataFrame:
    """(frame, truths, hits): how many truths of each frame are matched."""
    marked = truths.join(matched.select(key).distinct().withColumn("_h", F.lit(True)), key, "left")
    return marked.groupBy(*frame).agg(F.count("*").alias("truths"), F.count("_h").alias("hits"))


def largest_once(rows: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n groups of the largest value, each once, ties by group."""
    return rows.groupBy(*by).agg(F.max(value).alias(value)).orderBy(F.col(value).desc(), *by).limit(n)


def quartile_table(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(value, q).alias(name) for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])


def chain(steps: list[tuple[Column, str]]) -> Column:
    """A rationale: an array of (op, said)."""
    return F.array(*[F.struct(op.alias("op"), F.col(said).cast("string").alias("said")) for op, said in steps])


def valid_chain(steps: Column) -> Column:
    """Whether every step is an operation of the closed set and the last one concludes or abstains."""
    return F.forall(steps, lambda s: s["op"].isin(CHAIN_OPS)) & F.element_at(steps, -1)["op"].isin("conclude", "abstain")
