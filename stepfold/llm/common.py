"""Helpers that the training-data operators share: lineage cuts, row keys, vectorised tokenising and hashing."""

from __future__ import annotations

import math
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: everything between ASCII white space (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; a temporary one only on a local master that names none (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once and kept in the shared folder, so that a lost executor costs a read, not a recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, column: str) -> DataFrame:
    """`df`, whose partitions and rows stand in order, with the place of each row among all, from 0. It is computed once.

    The place in the partition is added to the number of rows before the partition; of that there is one row for each
    partition, which is what the broadcast holds, and no task sees all rows.
    """
    place = F.monotonically_increasing_id() % (1 << 33)
    placed = cut(df.select("*", F.spark_partition_id().alias("_part"), place.alias("_place")))
    before = F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_place")).alias(column))


def row_key(*cols: str) -> Column:
    """A hash of the named columns that never is null; equal rows get equal keys and so equal decisions."""
    return F.xxhash64(*[x for c in cols for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))])


def broadcast_if(df: DataFrame, fits: bool) -> DataFrame:
    """`df`, marked for broadcast where the caller has found it small."""
    return F.broadcast(df) if fits else df


def text_bytes(df: DataFrame, text: str = "text") -> int:
    """Total UTF-8 length of a column: one narrow scan that sizes partitions; nothing else reaches the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def power_of_two(n: float, least: int, most: int) -> int:
    return 1 << min(most, max(least, math.ceil(math.log2(max(n, 1)))))


SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and multiply), vectorised."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BASE_INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def rabin_karp(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of codes[start:end] for all pairs at once: prefix sums of code * base**i, shifted back by base**-start."""
    up, down = powers(len(codes) + 1)
    prefix = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * up[: len(codes)], dtype=np.uint64, out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """Words of many texts in one byte buffer; a space after each text keeps words of different texts apart."""

    def __init__(self, texts: list[str | None]):
        rows = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.frombuffer(b" ".join(rows) + b" ", dtype=np.uint8)
        lengths = np.fromiter((len(r) + 1 for r in rows), dtype=np.int64, count=len(rows))
        self.row_start = np.concatenate([[0], np.cumsum(lengths)])
        inside = np.zeros(len(self.bytes) + 1, dtype=np.int8)
        inside[1:] = ~SPACE[self.bytes]
        step = np.diff(inside)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        #: word index where each text begins; one more entry for the end
        self.first = np.searchsorted(self.start, self.row_start)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return rabin_karp(BYTE_CODE[self.bytes], self.start, self.end)

    def window_starts(self, n: int) -> np.ndarray:
        """Word index of every window of n words that lies inside one text."""
        full = np.maximum(self.count - n + 1, 0)
        offset = np.repeat(self.first[:-1] - np.concatenate([[0], np.cumsum(full)[:-1]]), full)
        return np.arange(full.sum()) + offset

    def joined(self, keep: np.ndarray) -> list[str]:
        """Per text, its kept words joined by one space."""
        edge = np.zeros(len(self.bytes) + 1, dtype=np.int8)
        edge[self.start[keep]] += 1
        edge[self.end[keep] + 1] -= 1  # the separator after a word stays with it
        mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
        data = self.bytes.copy()
        data[self.end] = 0x20
        data = data[mask].tobytes()
        upto = np.concatenate([[0], np.cumsum(mask)])[self.row_start]
        return [data[a : max(a, b - 1)].decode("utf-8", "surrogatepass") for a, b in zip(upto[:-1], upto[1:])]


def in_fixed_order(table: pa.Table, *cols: str) -> pa.Table:
    """Rows sorted by their values, so that two passes over one group see one order whatever the shuffle delivered."""
    return table.sort_by([(c, "ascending") for c in cols])
