"""Window and sequence operators over ordered logs. `by`: partition columns; `order`: a total order within them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(by: list[str], order: list[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order)


def state_fold(events: DataFrame, by: list[str], order: list[str], value: str, out: str = "current") -> DataFrame:
    """Adds the last non-null value so far, this row included: the state after each event."""
    frame = _over(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn(out, F.last(value, ignorenulls=True).over(frame))


def snapshot(events: DataFrame, by: list[str], order: list[str], value: str, upto: Column | None = None) -> DataFrame:
    """The latest non-null value of each key among the events that satisfy `upto`: one hash aggregation, no window."""
    kept = events.where(F.col(value).isNotNull() & (upto if upto is not None else F.lit(True)))
    return kept.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value), F.max_by(order[0], F.struct(*order)).alias("since"))


def change_events(events: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Only rows whose value differs from the one before, with `old` (null at first) and `new`."""
    old = F.lag(value).over(_over(by, order))
    return events.withColumn("old", old).withColumn("new", F.col(value)).where(~F.col("old").eqNullSafe(F.col("new"))).drop(value)


def merge_logs(derived: DataFrame, manual: DataFrame, by: list[str], step: str, tie: str) -> DataFrame:
    """Both logs with a position in (step, source, tie) order: manual rows come after derived rows of their step."""
    both = derived.withColumn("source", F.lit(0)).unionByName(manual.withColumn("source", F.lit(1)))
    return both.withColumn("position", F.row_number().over(_over(by, [step, "source", tie])).cast("long"))


def durations(steps: DataFrame, by: list[str], step: str, ts: str, long_gap_s: float) -> DataFrame:
    """Seconds since the step numbered one less, joined and not lagged: null if that step is missing or later."""
    previous = steps.select(*by, (F.col(step) + 1).alias(step), F.col(ts).alias("_previous"))
    joined = steps.join(previous, [*by, step], "left")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros(ts) - micros("_previous")) / F.lit(1e6)
    joined = joined.withColumn("duration_s", F.when(seconds >= 0, seconds)).drop("_previous")
    return joined.withColumn("long_gap", F.coalesce(F.col("duration_s") > long_gap_s, F.lit(False)))


def sequence_issues(rows: DataFrame, by: list[str], order: list[str], number: str) -> DataFrame:
    """Rows whose number was seen before (`duplicate`) or jumps ahead of the largest so far by over one (`gap`)."""
    before = _over(by, order).rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy(*by, number).orderBy(*order)
    marked = rows.withColumn("_nth", F.row_number().over(same)).withColumn("_most", F.max(number).over(before))
    issue = F.when(F.col("_nth") > 1, "duplicate").when(F.col(number) > F.col("_most") + 1, "gap")
    return marked.withColumn("issue", issue).where("issue is not null").drop("_nth", "_most")


def repeated_operations(actions: DataFrame, by: list[str], verb: str, order: list[str]) -> DataFrame:
    """Second and later occurrences of a verb on one instance, with the occurrence number."""
    return actions.withColumn("nth", F.row_number().over(_over([*by, verb], order)).cast("long")).where("nth > 1")


def ordinals(rows: DataFrame, by: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(_over(by, order)).cast("long"))


def islands(rows: DataFrame, by: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers as (first, last, n): gaps and islands over the distinct numbers."""
    distinct = rows.select(*by, number).distinct()
    run = F.col(number) - F.row_number().over(_over(by, [number]))
    return distinct.withColumn("_run", run).groupBy(*by, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("_run")


def compact_runs(runs: DataFrame, by: list[str]) -> DataFrame:
    """`1-3, 7 (n=4)` for each key from its islands."""
    part = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = runs.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("first", part.alias("text")))).alias("parts"), F.sum("n").alias("total"))
    return listed.select(*by, F.concat(F.array_join(F.col("parts.text"), ", "), F.lit(" (n="), F.col("total").cast("string"), F.lit(")")).alias("runs"))


def segments(boundaries: DataFrame, by: list[str], boundary: str, last: str) -> DataFrame:
    """Contiguous ranges cut at the boundaries b with 1 < b <= last: (seg, start, end), the first from 1."""
    inside = boundaries.where((F.col(boundary) > 1) & (F.col(boundary) <= F.col(last))).select(*by, last, boundary)
    starts = inside.union(boundaries.select(*by, last, F.lit(1).cast(boundaries.schema[boundary].dataType))).distinct()
    w = _over(by, [boundary])
    return starts.select(*by, F.row_number().over(w).cast("long").alias("seg"), F.col(boundary).alias("start"), F.coalesce(F.lead(boundary).over(w) - 1, F.col(last)).alias("end"))


def affected_steps(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Steps of every segment whose number or range changed, on either side."""
    keys = [*by, "seg", "start", "end"]
    changed = old.select(*keys).join(new.select(*keys), keys, "left_anti").union(new.select(*keys).join(old.select(*keys), keys, "left_anti"))
    return changed.select(*by, F.explode(F.sequence("start", "end")).alias("step")).distinct()


def reordered(rows: DataFrame, by: list[str], stated: list[str], actual: list[str]) -> DataFrame:
    """Rank by the actual order and the stated one; rows where they differ are the report."""
    return rows.withColumn("actual", F.row_number().over(_over(by, actual)).cast("long")).withColumn("stated", F.row_number().over(_over(by, stated)).cast("long")).where("actual <> stated")


def next_present(rows: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The first non-null `value` of a later row."""
    after = _over(by, order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(value, ignorenulls=True).over(after))


def progress_bins(rows: DataFrame, by: list[str], order: list[str], done: Column, bins: int = 4) -> DataFrame:
    """Done so far, of how many, and the share's bin (the last bin holds a share of 1)."""
    so_far = F.count_if(done).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.count_if(done).over(Window.partitionBy(*by))
    rows = rows.withColumn("done", so_far).withColumn("total", total).where("total > 0")
    return rows.withColumn("bin", F.least(F.floor(F.col("done") / F.col("total") * bins), F.lit(bins - 1)).cast("long"))


def hash_rank(by: list[str], key: Column, seed: str) -> Column:
    """Position in the deterministic pseudo-random order: crc32 of seed|key, then key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.crc32(F.concat(F.lit(f"{seed}|"), key)), key)).cast("long")


def balanced(rows: DataFrame, by: list[str], positive: Column, key: Column, seed: str) -> DataFrame:
    """All negatives, and as many positives, by hash rank, as there are negatives."""
    marked = rows.withColumn("_p", positive).withColumn("_n", F.count_if(~positive).over(Window.partitionBy(*by)))
    marked = marked.withColumn("_rank", hash_rank([*by, "_p"], key, seed))
    return marked.where(~F.col("_p") | (F.col("_rank") <= F.col("_n"))).drop("_p", "_n", "_rank")


def evenly_spaced(rows: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key at evenly spaced positions, the first among them."""
    w = _over(by, order)
    placed = rows.withColumn("_at", F.row_number().over(w) - 1).withColumn("_of", F.count("*").over(Window.partitionBy(*by)))
    new = F.floor(F.col("_at") * n / F.col("_of")) != F.floor((F.col("_at") - 1) * n / F.col("_of"))
    return placed.where((F.col("_of") <= n) | (F.col("_at") == 0) | new).drop("_at", "_of")


def epochs(rows: DataFrame, by: list[str], order: list[str], is_break: Column) -> DataFrame:
    """Sessions cut before each break: (epoch, rows, first and last of the order column)."""
    running = F.sum(is_break.cast("long")).over(_over(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("epoch", running).groupBy(*by, "epoch").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))
