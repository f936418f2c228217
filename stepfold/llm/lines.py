"""Cross-site boilerplate lines: HyperLogLog sketches of the sites of each line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import broadcast_if, cut, row_key

MIN_SITES = 10
LG_K = 10  #: 2**LG_K registers: a relative error of 3.3 % at most
BROADCAST_LINES = 1_000_000  #: line hashes (8 bytes each) up to which a set of lines is broadcast; beyond, it is shuffled
BAND = 0.25  #: estimates within this share of the threshold are counted exactly (over 7 standard errors)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """`line` hashes found on `min_sites` different sites at least; lines: (line, site)."""
    sketched = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    maybe = cut(sketched.where(F.col("sites") >= (1 - BAND) * min_sites))
    near = maybe.where(F.col("sites") <= (1 + BAND) * min_sites).select("line")
    # only rows of lines near the threshold are told apart by site
    few = broadcast_if(near, near.count() <= BROADCAST_LINES)
    exact = lines.join(few, "line", "left_semi").distinct().groupBy("line").count().where(F.col("count") >= min_sites)
    return maybe.where(F.col("sites") > (1 + BAND) * min_sites).select("line").union(exact.select("line"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source", counts: bool = False) -> DataFrame:
    """`docs` with boilerplate lines cut from `text`; with `counts` also n_lines and n_removed.

    A line (less spaces at its ends) that stands on `min_sites` sites goes everywhere but in its first place, by
    doc_id and line number; a null site is a site of its own. Blank lines always stay, so do rows whose text becomes
    empty. Lines and rows are told apart by 64-bit hashes (with N of them, a wrong match is expected N^2 / 2^65 times).
    Null texts stay null, with no lines. Rows that repeat another row wholly share its decisions; a null
    doc_id comes last. Other columns pass through, whatever their names.
    """
    key = row_key(doc_id, text)
    said = F.col(text).cast("string")
    ident = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("number").alias("number"))
    exploded = docs.select(key.alias("key"), F.col(doc_id), F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.posexplode(_lines(said)).alias("number", "said"))
    exploded = exploded.select("key", ident.alias("place"), "site", F.trim("said").alias("said")).where("said <> ''")
    hashed = exploded.select("key", "place", "site", F.xxhash64("said").alias("line"))
    common = cut(boilerplate(hashed.select("line", "site"), min_sites))
    fits = common.count() <= BROADCAST_LINES
    frequent = hashed.select("key", "place", "line").join(broadcast_if(common, fits), "line", "left_semi")
    first = frequent.groupBy("line").agg(F.min("place").alias("first"))
    # one join on the line, whose skewed side adaptive execution may split
    gone = frequent.join(broadcast_if(first, fits), "line").where(~F.col("place").eqNullSafe(F.col("first")))
    gone = gone.groupBy("key").agg(F.collect_set("place.number").alias("gone"))
    rows = docs.select(key.alias("key"), F.struct(*docs.columns).alias("row"), said.alias("said"))
    joined = rows.join(gone, "key", "left").withColumn("lines", F.when(F.col("gone").isNotNull(), _lines(F.col("said"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("said")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    out = joined.select(*[kept.alias(c) if c.lower() == text.lower() else F.col("row")[c].alias(c) for c in docs.columns], *([F.coalesce(F.size(_lines(F.col("said"))), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")] if counts else []))
    return out
