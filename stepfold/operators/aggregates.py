"""Aggregations: counters, exact percentiles in three definitions, accuracies, box combinations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def work_rows(frames: DataFrame, steps: DataFrame, keys: list[str], kind: str, skip: list[str]) -> DataFrame:
    """Frames left-joined to their steps; an absent or empty kind is `normal`, skipped kinds go."""
    joined = frames.join(steps.select(*keys, kind), keys, "left").withColumn(kind, F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("normal")))
    return joined.where(~F.col(kind).isin(skip))


def counters(sources: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """One row for each key and counter: n rows of each named source, all in one aggregation."""
    tagged = [df.select(*by, F.lit(name).alias("counter")) for name, df in sources.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy(*by, "counter").agg(F.count("*").alias("n"))


def pivot_counts(rows: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    return rows.groupBy(*by).pivot(column, values).count().fillna(0, values)


def moved_on(rows: DataFrame, by: list[str], digest: str, current: Column) -> DataFrame:
    """(n, stale) by key: rows, and rows whose digest is not the current one, nulls compared as values."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum((~F.col(digest).eqNullSafe(current)).cast("long")).alias("stale"))


def operation_counts(rows: DataFrame, by: list[str], verb: str) -> DataFrame:
    """Operations of an instance, how many repeat a verb, and whether it has over one."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(verb).alias("_d"))
    return g.select(*by, "n", (F.col("n") - F.col("_d")).alias("repeated"), (F.col("n") > 1).alias("many"))


def collisions(rows: DataFrame, by: list[str], outer: list[str]) -> DataFrame:
    """Sum of (count - 1) over the groups `by`, for each `outer` key."""
    return rows.groupBy(*by).agg((F.count("*") - 1).alias("_x")).groupBy(*outer).agg(F.sum("_x").alias("collisions"))


def majority_accuracy(rows: DataFrame, by: list[str], key: str, label: str) -> DataFrame:
    """How often "the most frequent label of each key" is right: sum of the largest counts over all."""
    per = rows.groupBy(*by, key, label).agg(F.count("*").alias("n")).groupBy(*by, key).agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.groupBy(*by).agg((F.sum("top") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def shortcut_report(rows: DataFrame, task: str, label: str) -> DataFrame:
    """Label counts of each task with the task's majority rate."""
    n = rows.groupBy(task, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(task)
    return n.withColumn("majority_rate", F.max("n").over(w) / F.sum("n").over(w))


def win_rates(rows: DataFrame, verb: str, won: Column) -> DataFrame:
    return rows.groupBy(verb).agg(F.count("*").alias("n"), F.avg(won.cast("double")).alias("win_rate"))


def option_shortcut(options: DataFrame, record: str, verb: str, correct: str) -> DataFrame:
    """Picking each record's option of best win rate: (records, hits, random baseline)."""
    rates = win_rates(options, verb, F.col(correct)).select(verb, "win_rate")
    scored = options.join(rates, verb)
    per = scored.groupBy(record).agg(F.max_by(correct, F.struct("win_rate", F.col(verb))).alias("hit"), F.count("*").alias("k"), F.count_if(correct).alias("c"))
    return per.agg(F.count("*").alias("records"), F.count_if("hit").alias("hits"), F.avg(F.col("c") / F.col("k")).alias("baseline"))


def nearest_rank(values: Column, q: float) -> Column:
    """Percentile of a sorted array at index round-half-even(q (n - 1))."""
    return F.element_at(values, (F.bround(F.lit(q) * (F.size(values) - 1)) + 1).cast("int"))


def upper_middle(values: Column) -> Column:
    """The median of a sorted array that takes index n div 2 and never averages."""
    return F.element_at(values, (F.floor(F.size(values) / 2) + 1).cast("int"))


def bands(rows: DataFrame, by: list[str], value: str, least: int) -> DataFrame:
    """p05, median and p95 by nearest rank for keys with `least` values; nulls are none.

    Equal values are counted first; ranks are running sums over a key's distinct values in order, which Spark sorts on
    disk where they do not fit, so no key's values ever come together in one row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*by)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    totals = counts.groupBy(*by).agg(F.sum("_c").alias("n")).where(F.col("n") >= least)
    placed = counts.withColumn("_upto", upto).join(totals, by)
    rank = lambda q: F.bround(F.lit(q) * (F.col("n") - 1)) + 1
    pick = lambda q: F.max(F.when((F.col("_upto") >= rank(q)) & (F.col("_upto") - F.col("_c") < rank(q)), F.col(value)))
    return placed.groupBy(*by, "n").agg(pick(0.05).alias("p05"), pick(0.5).alias("p50"), pick(0.95).alias("p95")).select(*by, "p05", "p50", "p95", "n")


def fitted_bands(rows: DataFrame, by: list[str], part: list[str], value: str, group: str, least_parts: int, least_groups: int) -> DataFrame:
    """Median of each part, then interpolated 5th and 95th percentile over parts, where parts and groups suffice."""
    parts = rows.groupBy(*by, *part, group).agg(F.percentile(value, 0.5).alias("_m"))
    g = parts.groupBy(*by).agg(F.percentile("_m", 0.05).alias("low"), F.percentile("_m", 0.95).alias("high"), F.count("*").alias("parts"), F.countDistinct(group).alias("groups"))
    return g.where((F.col("parts") >= least_parts) & (F.col("groups") >= least_groups))


def combine_boxes(rows: DataFrame, by: list[str], how: str) -> DataFrame:
    """One box (x0, y0, x1, y1) for each key.

    `union`; `trimmed`: the union of boxes of at most 1.5 times the upper-middle area; `median`: the upper-middle of
    each edge. Fewer than three boxes always give the union.
    """
    edges = ["x0", "y0", "x1", "y1"]
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    boxes = rows.groupBy(*by).agg(F.collect_list(F.struct(*edges, area.alias("area"))).alias("b"))
    sorted_of = lambda e: F.array_sort(F.transform("b", lambda x: x[e]))
    boxes = boxes.withColumn("_mid", upper_middle(sorted_of("area")))
    kept = F.filter("b", lambda x: x["area"] <= 1.5 * F.col("_mid")) if how == "trimmed" else F.col("b")
    boxes = boxes.withColumn("_k", F.when(F.size("b") < 3, F.col("b")).otherwise(kept))
    pick = {e: (F.array_min if e in ("x0", "y0") else F.array_max)(F.transform("_k", lambda x, e=e: x[e])) for e in ()}
    for e, f in zip(edges, (F.array_min, F.array_min, F.array_max, F.array_max)):
        outer = f(F.col(f"_k.{e}"))
        pick[e] = F.when(F.size("b") < 3, outer).otherwise(upper_middle(sorted_of(e))) if how == "median" else outer
    return boxes.select(*by, *[pick[e].alias(e) for e in edges])


def all_combinations(rows: DataFrame, dims: dict[str, list], value: str, threshold: float) -> DataFrame:
    """Mean, median and rate above a threshold for every combination of the listed values, also for those without rows."""
    spark = rows.sparkSession
    grid = spark.range(1)
    for d, values in dims.items():
        grid = grid.withColumn(d, F.explode(F.array(*[F.lit(v) for v in values])))
    g = rows.groupBy(*dims).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.avg((F.col(value) >= threshold).cast("double")).alias("rate"))
    return grid.drop("id").join(g, list(dims), "left").fillna(0, ["n"])


def earliest(rows: DataFrame, by: list[str], step: str, when: Column) -> DataFrame:
    return rows.where(when).groupBy(*by).agg(F.min(step).alias("first_step"))


def clock(rows: DataFrame, by: list[str], step: str, removed: Column, touched: Column) -> DataFrame:
    """First removal and last touch of each key."""
    return rows.groupBy(*by).agg(F.min(F.when(removed, F.col(step))).alias("removed_at"), F.max(F.when(touched, F.col(step))).alias("touched_at"))


def water_fill(counts: DataFrame, by: list[str], label: str, total: int) -> DataFrame:
    """Quotas of each label: equal shares of `total`, what small labels leave goes to the larger ones.

    Labels in order of size take min(size, what is left / labels left); a label's floor share is exact because the
    smaller ones before it are settled. Remainders go to the largest labels.
    """
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = w.orderBy("n", label)
    placed = counts.withColumn("_i", F.row_number().over(order)).withColumn("_k", F.count("*").over(w))
    listed = placed.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col("_i"), F.col("n"), F.col(label).alias("label")))).alias("all"))
    zero = F.struct(F.lit(total).cast("long").alias("left"), F.array().cast("array<struct<label:string,quota:bigint>>").alias("done"))
    step = lambda s, x: F.struct((s["left"] - F.least(x["n"], F.floor(s["left"] / (F.size("all") - x["_i"] + 1)))).alias("left"), F.concat(s["done"], F.array(F.struct(x["label"].cast("string").alias("label"), F.least(x["n"], F.floor(s["left"] / (F.size("all") - x["_i"] + 1))).alias("quota")))).alias("done"))
    filled = listed.select(*by, F.explode(F.aggregate("all", zero, step)["done"]).alias("q"))
    return filled.select(*by, F.col("q.label").alias(label), F.col("q.quota").alias("quota"))
