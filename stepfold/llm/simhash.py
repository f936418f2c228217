"""SimHash near-duplicates: 64-bit fingerprints, linked within a Hamming radius by tiled exact comparison.

All texts with one fingerprint are one node, so copies are never expanded into pairs. Fingerprints are cut into
`radius + spare` bit blocks; two within the radius agree on `spare` blocks at least, so comparing inside each
(choice of blocks, value) group finds every link and compares each group's fingerprints exactly. A group is dealt
out in tiles of bounded size, one task row set per pair of tiles; inside it fingerprints are ordered by population
count and tile pairs whose counts differ beyond the radius are skipped, the rest compared by exclusive-or and bit
count in numpy.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from stepfold.llm.common import cut, row_key
from stepfold.llm.graph import connected_components

RADIUS = 4
SHINGLE = 4
TILE = 2048
STRIP = 512


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined, at = b" ".join(words), np.cumsum([0] + [len(w) + 1 for w in words])
    n = max(len(words) - shingle + 1, 1)
    lo, hi = at[:n].tolist(), (at[min(shingle, len(words)) :] - 1).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 4096):
        h = np.fromiter((digest(view[a:b], 42) for a, b in zip(lo[k : k + 4096], hi[k : k + 4096])), dtype=np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` columns beside `text` and a signed 64-bit `fingerprint`; text itself is not carried on."""
    rest = [c for c in docs.columns if c.lower() != text.lower()]
    packed = docs.select(F.struct(*rest).alias("kept") if rest else F.lit(1).alias("kept"), F.col(text).cast("string").alias("said"))

    def run(batches):
        for b in batches:
            f = np.fromiter((fingerprint(t, shingle) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], names=["kept", "fingerprint"])

    return packed.mapInArrow(run, packed.select("kept").withColumn("fingerprint", F.lit(0).cast("long")).schema)


def block_masks(blocks: int) -> list[int]:
    edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:])]


def near(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) within the radius; both ordered by population count."""
    pa_, pb = np.bitwise_count(a).astype(int), np.bitwise_count(b).astype(int)
    left, right = [], []
    for i in range(0, len(a), STRIP):
        for j in range(0, len(b), STRIP):
            if pa_[i] - pb[min(j + STRIP, len(b)) - 1] > radius or pb[j] - pa_[min(i + STRIP, len(a)) - 1] > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(a[i : i + STRIP, None] ^ b[None, j : j + STRIP]) <= radius)
            left.append(x + i)
            right.append(y + j)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def spanning(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the pairs (x, y): minima spread until nothing changes."""
    root = np.arange(n)
    while True:
        was = root.copy()
        np.minimum.at(root, x, root[y])
        np.minimum.at(root, y, root[x])
        root = root[root]
        if np.array_equal(root, was):
            return root


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) of labels that connect exactly what links within `radius` connect; `nodes`: distinct signed `fp`, `label`.

    Each group of compared fingerprints returns a star per connected set instead of all its pairs, so the number of
    edges stays in proportion to the fingerprints. `blocks` (by default more for more fingerprints) changes the sizes
    of the compared groups, never what is connected.
    """
    n = nodes.count()
    if blocks is None:
        blocks = radius + 1
        while blocks < radius + 4 and n >> (64 * (blocks - radius) // blocks) > tile:  # more blocks, more bits agree
            blocks += 1
    masks = [sum(m) for m in combinations(block_masks(blocks), blocks - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select("fp", "label", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "value"))
    sizes = keyed.groupBy("choice", "value").agg(F.count("*").alias("n")).where(F.col("n") > tile)
    big = sizes.select("choice", "value", F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    dealt = keyed.join(big, ["choice", "value"], "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # small groups share a coarse key: few groups of useful size instead of many tiny ones
    coarse = max(1, n // 1024)
    dealt = dealt.withColumn("part", F.when(F.col("tiles") == 1, F.pmod(F.xxhash64("value"), F.lit(coarse))).otherwise(F.col("value")))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("choice", "part", "tiles", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile", "value", "fp", "label")

    def compare(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        value, side = table.column("value").to_numpy(), table.column("tile").to_numpy()
        u, v = [], []
        order = np.lexsort((np.bitwise_count(fp), value))
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for own in np.split(order, cuts):
            if len(own) < 2:
                continue
            f, s = fp[own], side[own]
            if s.min() == s.max():
                x, y = near(f, f, radius)
            else:
                first, second = np.flatnonzero(s == s.min()), np.flatnonzero(s == s.max())
                x, y = near(f[first], f[second], radius)
                x, y = first[x], second[y]
            if (x != y).any():
                root = spanning(len(f), x, y)
                moved = np.flatnonzero(root != np.arange(len(f)))
                u.append(own[moved])
                v.append(own[root[moved]])
        label = table.column("label").combine_chunks()
        return pa.table({c: label.take(pa.array(np.concatenate(at) if at else np.empty(0, np.int64))) for c, at in (("u", u), ("v", v))})

    kind = nodes.schema["label"].dataType
    edges = StructType([StructField("u", kind), StructField("v", kind)])
    return dealt.groupBy("choice", "part", "tiles", "a", "b").applyInArrow(compare, edges)


def rooted(prints: DataFrame, radius: int, rank: Column) -> DataFrame:
    """(fp, label, root) for each distinct `fp` of `prints`: its label is its smallest `rank` and itself, and linked
    fingerprints have the smallest label among them as root. No set of linked fingerprints is ever grouped."""
    nodes = cut(prints.groupBy("fp").agg(F.min(rank).alias("least")).select("fp", F.struct("least", "fp").alias("label")))
    roots = connected_components(links(nodes, radius))
    return nodes.join(roots, nodes["label"] == roots["node"], "left").select("fp", "label", F.coalesce("root", "label").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id take part; a
    component of nulls only has a null id. Repeated rows come back as often as they came, and different texts under one
    id are linked only if their fingerprints are. Other columns are left out.
    """
    prints = cut(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle).select(F.col("kept.doc_id").alias("doc_id"), F.col("fingerprint").alias("fp")))
    named = rooted(prints, radius, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id")))
    named = named.select(F.col("fp").alias("node"), F.col("root.least.id").alias("component_id"))
    out = prints.join(named, prints["fp"] == named["node"], "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each group of near duplicates; all columns pass through.

    The row with the smallest doc_id stays, null last; of rows with one id the one whose id and text have the smallest
    hash, and of rows with one id and text the one with the smallest hash of all columns. Ids only rank rows: different
    texts under one id, or without one, are different documents.
    """
    own = docs.select(F.col(doc_id).alias("id"), row_key(doc_id, text).alias("key"), F.col(text).alias("text"))
    prints = cut(fingerprints(own, "text", shingle).select(F.struct(F.col("kept.id").isNull().alias("none"), F.col("kept.id").alias("id"), F.col("kept.key").alias("key")).alias("rank"), F.col("fingerprint").alias("fp")))
    first = rooted(prints, radius, F.col("rank")).where("label = root").select(F.col("label.least.id").alias("first_id"), F.col("label.least.key").alias("first_key"))
    packed = docs.select(F.col(doc_id).alias("own_id"), row_key(doc_id, text).alias("own_key"), F.struct(*docs.columns).alias("row"))
    kept = packed.join(first, F.col("own_id").eqNullSafe(F.col("first_id")) & (F.col("own_key") == F.col("first_key")), "left_semi")
    return kept.groupBy("own_id", "own_key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
