"""Hashes of a chunk of texts, sent to hash ranges as sorted blobs: the vectorised rows of a hash-partitioned join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import row_key

CHUNK_BYTES = 4 << 20  #: text of a chunk, about
RANGE_HASHES = 1 << 19  #: hashes of a range, about


def deal(docs: DataFrame, chunks: int, doc_id: str, text: str) -> DataFrame:
    """(chunk, doc_id, text) of all rows. Equal rows of one input partition share a chunk, those of different ones do not:
    a row that repeats through the whole table is spread, and a task that runs again deals its rows as before."""
    chunk = F.pmod(F.xxhash64(row_key(doc_id, text), F.spark_partition_id()), F.lit(chunks)).cast("int")
    return docs.select(chunk.alias("chunk"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def ranges(sorted_hashes: np.ndarray, bits: int) -> np.ndarray:
    """Offsets at which each of 2**bits hash ranges begins, and the end."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def planes(values: np.ndarray) -> bytes:
    """Integers by byte position, all low bytes first: small numbers leave planes of zeros, which shuffles compress away."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def blobs(hashes: np.ndarray, bits: int, chunk: int, more: np.ndarray | None = None) -> pa.Table:
    """One row for each range that has hashes. The top byte is the range's own (bits is 8 at least), so 7 travel."""
    at = ranges(hashes, bits)
    full = np.flatnonzero(np.diff(at))
    low = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7])
    top = hashes >> np.uint64(56)
    rows = {"part": full.astype(np.int32), "chunk": np.full(len(full), chunk, np.int32), "top": top[at[full]].astype(np.int32)}
    table = {k: pa.array(v) for k, v in rows.items()}
    table["hashes"] = pa.array([low[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())
    table["counts"] = pa.array([planes(more[at[k] : at[k + 1]]) for k in full] if more is not None else [b""] * len(full), pa.binary())
    return pa.table(table)


BLOBS = "part int, chunk int, top int, hashes binary, counts binary"


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a part, in the order of its blobs, and where each blob begins."""
    raw = table.column("hashes").to_pylist()
    sizes = np.array([len(b) // 7 for b in raw])
    wide = np.zeros((sizes.sum(), 8), dtype=np.uint8)
    wide[:, :7] = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, 7)
    wide[:, 7] = np.repeat(table.column("top").to_numpy().astype(np.uint8), sizes)
    return wide.reshape(-1).view("<u8"), np.concatenate([[0], np.cumsum(sizes)])
