"""Mixing sources to target weights: every document is copied 0, 1 or 2 times by pivotal dependent rounding.

A document's expected copies are its source's target over the source's size. The fractional parts are rounded in
small groups: two open documents exchange words at random until one of them has a whole number of copies; the other
meets the next one. Exchanges keep the group's expected words. A group's last open document goes on to the next level
of a reduction tree (groups of groups, within one source) until one document of a source is left, which is rounded
alone; so a source misses its target by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.common import WORD, broadcast_if, cut, row_key

CYCLE = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
FAN_IN = 32
EPS = 1e-9
BROADCAST_SOURCES = 100_000  #: sources up to which their targets are broadcast; beyond, they are shuffled
PIECE = 1 << 16  #: equal rows that are numbered in one array


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, n, target) from (source, size) rows.

    Sources by code point, null last, weigh `cycle`, repeating; they share `share` of all words by weight. No target
    exceeds `limit` times its source: with sources in the order of that bound over their weight, the bounded ones are
    a prefix, found by running sums. The windows hold one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * limit)
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("place", F.row_number().over(order))
    free = F.min(F.when(F.col("most") > F.col("w") * F.col("level"), F.struct("place", "level"))).over(everything)  # the first that is not bounded
    leveled = leveled.withColumn("free", free)
    bounded = F.col("free").isNull() | (F.col("place") < F.col("free.place"))
    return leveled.select("source", "source_size", "n", F.when(bounded, F.col("most")).otherwise(F.col("w") * F.col("free.level")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _pivot(items: Column) -> Column:
    """Fold over an array of open items (h, id, size, whole, x, u): the closed ones, with x rounded, and the last open one."""

    def step(state: Column, item: Column) -> Column:
        a, s, b, t = state["open"]["x"], state["open"]["size"], item["x"], item["size"]
        up, down = F.least(s * (1 - a), t * b), F.least(s * a, t * (1 - b))  # words that may move to or from the open item
        moved = F.when(item["u"] * (up + down) < down, up).otherwise(-down)
        closed = lambda x: (x < EPS) | (x > 1 - EPS)
        pair = F.transform(F.array(F.struct(state["open"].alias("it"), (a + moved / s).alias("x")), F.struct(item.alias("it"), (b - moved / t).alias("x"))), lambda p: p["it"].withField("x", F.when(p["x"] < EPS, 0.0).when(p["x"] > 1 - EPS, 1.0).otherwise(p["x"])))
        first, second = pair[0], pair[1]
        goes_on = F.when(closed(first["x"]), second).otherwise(first)
        done = F.when(closed(first["x"]), first).otherwise(second)
        return F.struct(F.concat(state["done"], F.array(done)).alias("done"), goes_on.alias("open"))

    start = F.struct(F.slice(items, 1, 0).alias("done"), items[0].alias("open"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def round_copies(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """(key, doc_id, source, size, copies): `sized` rows (key, nth, doc_id, source, size) with their whole number of copies."""
    joined = sized.join(broadcast_if(targets, targets.count() <= BROADCAST_SOURCES), sized["source"].eqNullSafe(targets["source"])).select(sized["*"], "n", "target", "source_size")
    p = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    item = joined.withColumn("p", p).withColumn("whole", F.floor(F.col("p") + EPS).cast("int")).withColumn("x", F.greatest(F.col("p") - F.col("whole"), F.lit(0.0)))
    item = item.withColumn("h", F.xxhash64("key", "nth", F.lit(seed)))
    settled = (F.col("x") < EPS) | (F.col("size") == 0)
    closed = item.where(settled).select("key", "doc_id", "source", "size", F.col("whole").alias("copies"))
    groups = F.greatest(F.ceil(F.col("n") / FAN_IN), F.lit(1))
    fields = ["h", "key", "doc_id", "size", "whole", "x"]
    level, depth = item.where(~settled).select("source", F.pmod("h", groups).alias("g"), F.struct(*fields).alias("it")), 0
    most = targets.agg(F.max("n")).first()[0] or 0
    while True:
        u = _uniform(F.col("it.h"), F.col("it.size"), F.lit(seed), F.lit(depth))
        gathered = level.groupBy("source", "g").agg(F.sort_array(F.collect_list(F.col("it").withField("u", u))).alias("items"))
        folded = cut(gathered.select("source", "g", _pivot(F.col("items")).alias("s")))
        done = folded.select("source", F.explode("s.done").alias("it"))
        last = most <= FAN_IN
        if last:
            alone = F.col("s.open").withField("x", F.when(_uniform(F.col("s.open.h"), F.lit(seed), F.lit(-1)) < F.col("s.open.x"), 1.0).otherwise(0.0))
            done = done.union(folded.select("source", alone.alias("it")))
        closed = closed.union(done.select("it.key", "it.doc_id", "source", "it.size", (F.col("it.whole") + F.round("it.x").cast("int")).alias("copies")))
        if last:
            return closed
        level = folded.select("source", F.floor(F.col("g") / FAN_IN).alias("g"), F.col("s.open").dropFields("u").alias("it"))
        most, depth = -(-most // FAN_IN), depth + 1


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def mix(docs: DataFrame, cycle: tuple[int, ...] = CYCLE, share: float = SHARE, limit: float = LIMIT, seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of `docs`: key, doc_id, size (words), source_size, target, copies, taken (words).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own. Reruns agree: all
    draws are hashes of a row and the seed. Repeated rows are numbered, so that each has its group and its draws. An
    empty table has no sources. Rows are told apart by a 64-bit hash of all columns. Other columns are left out.
    """
    own = docs.select(row_key(*docs.columns).alias("key"), F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
    equal = own.groupBy("key", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    piece = equal.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    numbered = piece.withColumn("nth", F.explode(F.sequence(F.col("piece") * PIECE, F.least(F.col("n"), (F.col("piece") + 1) * PIECE) - 1)))
    sized = cut(numbered.select("key", "nth", "doc_id", "source", "size"))
    targets = cut(source_targets(sized, cycle, share, limit))
    rounded = round_copies(sized, targets, seed)
    named = targets.select(F.col("source").alias("of"), "source_size", "target")
    out = rounded.join(broadcast_if(named, named.count() <= BROADCAST_SOURCES), rounded["source"].eqNullSafe(named["of"]))
    return out.select("key", "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def materialize(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """`docs` with each row as often as it was taken. Rows equal in all columns are one row, taken as often as all of them."""
    total = mixed.groupBy("key").agg(F.sum("copies").alias("copies")).where(F.col("copies") > 0)
    packed = docs.select(row_key(*docs.columns).alias("key"), F.struct(*docs.columns).alias("row")).dropDuplicates(["key"])
    return packed.join(total, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
