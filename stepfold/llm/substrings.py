"""Removal of passages that repeat: Rabin-Karp hashes of every window of n words, counted over the whole table.

Texts are dealt into chunks by a hash of the row. A chunk hashes all its windows in numpy and sends each distinct
hash once, in sorted blobs by hash range, so that a passage that repeats often in a chunk costs one entry. Each hash
range counts its blobs and answers every chunk with one bit a hash: seen elsewhere or not. The chunk, read from the
same shuffle, turns the bits into covered words. Hashes have 64 bits; no location ever travels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import Words, in_fixed_order, power_of_two, rabin_karp, text_bytes
from stepfold.llm.exchange import BLOBS, CHUNK_BYTES, RANGE_HASHES, blobs, deal, ranges, unpack

WINDOW = 35


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start (as a word index) and hash of each window."""
    at = words.window_starts(n)
    return at, rabin_karp(words.hashes(), at, at + n)


def seen_elsewhere(table: pa.Table) -> pa.Table:
    """Each chunk sends a hash once: a hash with a neighbour in sorted order is another chunk's too."""
    h, at = unpack(table)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    flag = np.zeros(len(h), dtype=bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "seen": pa.array(bits, pa.binary())})


def remove_repeats(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, removed (maximal word ranges, end exclusive), kept_text.

    A word goes if a window of `window` words that covers it also starts anywhere else in the table, the same text
    included; kept words are joined by one space. Null and empty texts, and texts shorter than a window, lose
    nothing. Repeated rows are different texts and take each other's words. Windows are judged on the input.
    """
    size = text_bytes(docs, text)
    chunks = max(256, size // CHUNK_BYTES)
    bits = power_of_two(size / 6 / RANGE_HASHES, 8, 24).bit_length() - 1
    dealt = deal(docs, chunks, doc_id, text)

    def send(table: pa.Table) -> pa.Table:
        table = in_fixed_order(table, "doc_id", "text")
        _, h = windows(Words(table.column("text").to_pylist()), window)
        return blobs(np.unique(h), bits, table.column("chunk")[0].as_py())

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_fixed_order(table, "doc_id", "text")
        words = Words(table.column("text").to_pylist())
        at, h = windows(words, window)
        h, back, counts = np.unique(h, return_inverse=True, return_counts=True)
        repeated = counts > 1
        bounds = ranges(h, bits)
        for part, seen in zip(answers.column("part").to_pylist(), answers.column("seen").to_pylist()):
            a, b = bounds[part], bounds[part + 1]
            repeated[a:b] |= np.unpackbits(np.frombuffer(seen, np.uint8), count=b - a).astype(bool)
        hit = at[repeated[back]]
        edge = np.zeros(len(words.start) + 1, dtype=np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])[words.first]
        lead = np.zeros(len(gone) + 1, dtype=np.int8)
        lead[1:] = gone
        begin = np.zeros(len(gone) + 1, dtype=bool)
        begin[words.first[words.first < len(gone)]] = True  # a range ends with its text
        starts = np.flatnonzero(gone & ((lead[:-1] == 0) | begin[:-1]))
        follows = np.concatenate([gone[1:], [False]]) & ~np.concatenate([begin[1:-1], [True]]) if len(gone) else gone
        ends = np.flatnonzero(gone & ~follows) + 1
        row = np.searchsorted(words.first, starts, "right") - 1
        off = np.searchsorted(row, np.arange(table.num_rows + 1))
        spans = pa.StructArray.from_arrays([pa.array(starts - words.first[row]), pa.array(ends - words.first[row])], ["start", "end"])
        return pa.table(
            {
                "doc_id": table.column("doc_id"),
                "n_words": pa.array(words.count.astype(np.int64)),
                "n_removed": pa.array(np.diff(upto).astype(np.int64)),
                "removed": pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), spans),
                "kept_text": pa.array(words.joined(~gone), pa.string()),
            }
        )

    sent = dealt.groupBy("chunk").applyInArrow(send, BLOBS)
    answers = sent.select("part", "chunk", "top", "hashes").groupBy("part").applyInArrow(seen_elsewhere, "chunk int, part int, seen binary")
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept_text string")
