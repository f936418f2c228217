"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by their number of distinct shingles (powers of two). An item's sketch is its bottom-k MinHash,
k being one more than the shingles that an item of its partition may lack at the threshold, so a document that
contains enough of an item has one of the sketch's shingles for certain. All shingle positions of all documents are
looked up in the sketches; what is found is verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import broadcast_if, cut, row_key

SHINGLE = 5
CONTAINMENT = 0.8
BROADCAST_BYTES = 64 << 20  #: size of all items' shingles up to which the item tables are broadcast; beyond, they are shuffled


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _runs(words: Column, width: int, of) -> Column:
    """`of` the words of each run of `width` words, in order; words are reached by index, as slices copy the array."""
    at = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: of(*[F.get(words, i + k) for k in range(width)]))


def shingles_of(words: Column, width: int) -> Column:
    """All shingles as words joined by one space; an empty array for fewer words."""
    return _runs(words, width, lambda *w: F.concat_ws(" ", *w))


def hashes_of(words: Column, width: int) -> Column:
    return _runs(words, width, F.xxhash64)


def prepared_items(items: DataFrame, item_id: str, text: str, shingle: int, containment: float) -> tuple[DataFrame, DataFrame]:
    """Distinct items as (item, width, shingles, sketch), and the ids (item, item_id) that share each of them.

    item is a 64-bit hash of the shingles; ids may be as many as they will, as no row gathers them.
    """
    w = items.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    w = w.select("item_id", F.least(F.lit(shingle), F.size("words")).alias("width"), "words")
    by_width = lambda of: F.coalesce(*[F.when(F.col("width") == k, of(F.col("words"), k)) for k in range(1, shingle + 1)])
    s = w.select("item_id", "width", F.array_sort(F.array_distinct(by_width(shingles_of))).alias("shingles"), F.array_sort(F.array_distinct(by_width(hashes_of))).alias("hashes"))
    s = cut(s.withColumn("item", F.xxhash64("width", "shingles")))
    one = s.groupBy("item").agg(*[F.first(c).alias(c) for c in ("width", "shingles", "hashes")])
    largest = F.pow(F.lit(2.0), F.floor(F.log2(F.size("shingles"))) + 1) - 1  # of the size partition
    k = F.least(F.floor((1 - containment) * largest + 1e-9).cast("int") + 1, F.size("shingles"))
    return one.select("item", "width", "shingles", F.slice("hashes", F.lit(1), k).alias("sketch")), s.select("item", "item_id")


def contained(docs: DataFrame, items: DataFrame, shingle: int = SHINGLE, containment: float = CONTAINMENT, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, doc_id, item_id, n_shingles, n_found, containment) for each item contained in each document.

    Containment is the share of an item's distinct `shingle`-word shingles that the document has; items of fewer
    words are one shingle. Words are lower-cased runs of anything but ASCII white space. Null or empty texts contain
    nothing and are contained nowhere. Equal items all come back. Repeated documents each have their rows.
    """
    ready, members = prepared_items(items, item_id, item_text, shingle, containment)
    ready = cut(ready)
    size, widths = ready.agg(F.coalesce(F.sum(F.octet_length(F.array_join("shingles", "")) + 16 * F.size("shingles")), F.lit(0)), F.sort_array(F.collect_set("width"))).first()
    small = lambda df: broadcast_if(df, size <= BROADCAST_BYTES)
    sketch = ready.select("item", F.explode("sketch").alias("h")).distinct()
    key = row_key(doc_id, text)
    hashes = [hashes_of(F.col("words"), w) for w in widths or [shingle]]
    tokens = docs.select(key.alias("key"), words_of(F.col(text)).alias("words"))
    looked_up = tokens.select("key", F.explode(F.concat(*hashes)).alias("h")).join(small(sketch), "h")
    candidates = looked_up.select("key", "item").distinct()
    whole = candidates.join(small(ready.select("item", "width", "shingles")), "item")
    per_doc = whole.groupBy("key").agg(F.collect_list(F.struct("item", "width", "shingles")).alias("items"))
    rows = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("said")).join(per_doc, "key")
    rows = rows.select("key", "doc_id", "items", words_of(F.col("said")).alias("words"))
    rows = rows.select("key", "doc_id", "items", *[shingles_of(F.col("words"), w).alias(f"s{w}") for w in widths or [shingle]])
    of_width = F.coalesce(*[F.when(F.col("i.width") == w, F.col(f"s{w}")) for w in widths or [shingle]])
    judged = rows.withColumn("i", F.explode("items")).select("key", "doc_id", F.col("i.item").alias("item"), F.size("i.shingles").cast("long").alias("n_shingles"), F.size(F.array_intersect("i.shingles", of_width)).cast("long").alias("n_found"))
    judged = judged.withColumn("containment", F.col("n_found") / F.col("n_shingles")).where(F.col("n_found") >= containment * F.col("n_shingles") - 1e-9)
    return judged.join(members, "item").select("key", "doc_id", "item_id", "n_shingles", "n_found", "containment")


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """`docs` less the rows that contain an item; all other rows and all columns pass through, whatever their names.

    Null and empty texts contain nothing and stay; repeated rows share their fate; without items every row stays.
    """
    bad = contained(docs, items, **options).select("key").distinct()
    packed = docs.select(row_key(options.get("doc_id", "doc_id"), options.get("text", "text")).alias("key"), F.struct(*docs.columns).alias("row"))
    return packed.join(bad, "key", "left_anti").select("row.*")
