"""Review queries: data-quality rules, coverage of versions, work items, cache decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(rules: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, rule) of all rules' rows: each rule is an anti join or a filter of its own."""
    return reduce(DataFrame.unionByName, [df.select(F.col(key).cast("string").alias("key"), F.lit(name).alias("rule")) for name, df in rules.items()])


def coverage(needed: DataFrame, drawn: DataFrame, keys: list[str], frame: list[str], on_bench: Column) -> DataFrame:
    """needed, drawn, missing and missing-on-bench counts of each frame."""
    marked = needed.join(drawn.select(*keys).distinct().withColumn("_d", F.lit(True)), keys, "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
    return marked.groupBy(*frame).agg(F.count("*").alias("needed"), F.count_if("_d").alias("drawn"), F.count_if(~F.col("_d")).alias("missing"), F.count_if(~F.col("_d") & on_bench).alias("bench_missing"))


def task_cards(now: DataFrame, neighbour: DataFrame, keys: list[str], state: str) -> DataFrame:
    """Work items from the difference to the neighbour: appear, vanish or change."""
    a = now.select(*keys, F.col(state).alias("now"))
    b = neighbour.select(*keys, F.col(state).alias("was"))
    both = a.join(b, keys, "full_outer")
    kind = F.when(F.col("was").isNull(), "appear").when(F.col("now").isNull(), "vanish").when(F.col("now") != F.col("was"), "change")
    return both.withColumn("kind", kind).where("kind is not null")


def cache_decisions(index: DataFrame, manifest: DataFrame, keys: list[str], version: int) -> DataFrame:
    """What to do with each cached file: copy, rechoose (stale metrics), relabel, skip or drop."""
    i = index.select(*keys, "size", "label", F.lit(True).alias("_i"))
    m = manifest.select(*keys, F.col("size").alias("_size"), F.col("label").alias("_label"), "version", F.lit(True).alias("_m"))
    both = i.join(m, keys, "full_outer")
    decision = (
        F.when(F.col("_i").isNull(), "drop")
        .when(F.col("_m").isNull() | ~F.col("size").eqNullSafe(F.col("_size")), "copy")
        .when(~F.col("version").eqNullSafe(F.lit(version)), "rechoose")
        .when(~F.col("label").eqNullSafe(F.col("_label")), "relabel")
        .otherwise("skip")
    )
    return both.select(*keys, decision.alias("decision"))


def implausible(previous: Column, present: Column, dropped: Column, real: Column) -> Column:
    """A re-import that must be refused: under 0.6 of the steps, over five drops, or over a fifth of the real rows."""
    return F.coalesce((present < 0.6 * previous) | (dropped > 5) | (dropped > 0.2 * real), F.lit(False))


def split_rows(rows: DataFrame, n: Column, out: str = "part") -> DataFrame:
    """One row becomes n numbered ones."""
    return rows.withColumn(out, F.explode(F.sequence(F.lit(1).cast("long"), n)))


def within_bands(area: Column, bands: list[tuple[float, float]], factor: float) -> Column:
    """Whether an area is within `factor` of some class band."""
    off = [F.when(area < lo, F.lit(lo) / area).when(area > hi, area / F.lit(hi)).otherwise(1.0) for lo, hi in bands]
    return (F.least(*off) if len(off) > 1 else off[0]) <= factor
