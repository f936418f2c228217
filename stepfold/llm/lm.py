"""Stupid-backoff scores of every text under the n-gram counts of the whole table, less the text's own.

Chunks of texts send each distinct n-gram hash once with its count; hash ranges sum the counts (the count tables,
partitioned by hash) and answer every chunk with the totals of the n-grams that it has (the join); the chunk sums
the scores of each text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import Words, in_fixed_order, power_of_two, rabin_karp
from stepfold.llm.exchange import BLOBS, CHUNK_BYTES, RANGE_HASHES, blobs, deal, from_planes, planes, ranges, unpack

ORDER = 2
BACKOFF = 0.4


def extent(docs: DataFrame, text: str) -> tuple[int, int]:
    """UTF-8 bytes and words of the whole column."""

    def count(batches):
        for b in batches:
            rows = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"bytes": [sum(map(len, rows))], "words": [sum(len(r.split()) for r in rows)]})

    got = docs.select(F.col(text).cast("string").alias("said")).mapInArrow(count, "bytes long, words long").agg(F.sum("bytes"), F.sum("words")).first()
    return int(got[0] or 0), int(got[1] or 0)


def grams(words: Words, order: int) -> list[np.ndarray]:
    """For each n up to `order`, the hash of the n-gram that ends at each word; 0 where the text is still too short."""
    codes, place = words.hashes(), np.arange(len(words.start)) - np.repeat(words.first[:-1], words.count)
    found = []
    for n in range(1, order + 1):
        h = np.zeros(len(codes), dtype=np.uint64)
        at = np.flatnonzero(place >= n - 1)
        h[at] = rabin_karp(codes, at - n + 1, at + 1)
        found.append(h)
    return found


def totals(table: pa.Table) -> pa.Table:
    """The count of each hash over all chunks, sent back in the order in which each chunk sent its hashes."""
    h, at = unpack(table)
    counts = np.concatenate([from_planes(b, np.uint32) for b in table.column("counts").to_pylist()])
    _, back = np.unique(h, return_inverse=True)
    total = np.bincount(back, weights=counts).astype(np.uint64)[back] if len(h) else counts.astype(np.uint64)
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([planes(total[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())})


def backoff_scores(words: Words, total: list[np.ndarray], own: list[np.ndarray], corpus: int, backoff: float) -> np.ndarray:
    """Natural log score of each word. Counts exclude the word's own text; an unseen word has one count in N + 1."""
    rest = corpus - np.repeat(words.count, words.count)
    left = [t.astype(np.int64) - o for t, o in zip(total, own)]
    score = np.where(left[0] > 0, np.log(np.maximum(left[0], 1)) - np.log(np.maximum(rest, 1)), -np.log1p(rest))
    previous = np.concatenate([[0], np.arange(len(words.start) - 1)]) if len(words.start) else np.empty(0, int)
    place = np.arange(len(words.start)) - np.repeat(words.first[:-1], words.count)
    for n in range(1, len(left)):  # from the lower to the higher orders, each replaces or discounts the one below
        context = left[n - 1][previous]
        seen = np.log(np.maximum(left[n], 1)) - np.log(np.maximum(context, 1))
        score = np.where(place < n, score, np.where(left[n] > 0, seen, score + np.log(backoff)))
    return score


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, log_score (sum of natural logs), mean_log_score.

    Words are runs of anything but ASCII white space. Null and empty texts have no words and scores of 0. Repeated
    rows are different texts, each counting for the other. Other columns are left out.
    """
    size, corpus = extent(docs, text)
    chunks = max(256, size // CHUNK_BYTES)
    bits = power_of_two(order * size / 6 / RANGE_HASHES, 8, 24).bit_length() - 1
    dealt = deal(docs, chunks, doc_id, text)

    def send(table: pa.Table) -> pa.Table:
        words = Words(in_fixed_order(table, "doc_id", "text").column("text").to_pylist())
        h = np.concatenate(grams(words, order))
        h, n = np.unique(h[h != 0], return_counts=True)
        return blobs(h, bits, table.column("chunk")[0].as_py(), n.astype(np.uint32))

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = in_fixed_order(table, "doc_id", "text")
        words = Words(table.column("text").to_pylist())
        each = grams(words, order)
        h, back = np.unique(np.concatenate(each), return_inverse=True)
        total = np.zeros(len(h), dtype=np.uint64)
        skip = int(len(h) > 0 and h[0] == 0)
        bounds = ranges(h[skip:], bits) + skip
        for part, got in zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist()):
            total[bounds[part] : bounds[part + 1]] = from_planes(got, np.uint64)
        row = np.repeat(np.arange(table.num_rows), words.count)
        _, pair, times = np.unique(back * max(1, table.num_rows) + np.tile(row, order), return_inverse=True, return_counts=True)
        n = len(row)
        s = backoff_scores(words, [total[back[k * n : k * n + n]] for k in range(order)], [times[pair[k * n : k * n + n]] for k in range(order)], corpus, backoff)
        sums = np.bincount(row, weights=s, minlength=table.num_rows).astype(float)  # of no words numpy makes integers
        mean = sums / np.maximum(words.count, 1)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(words.count.astype(np.int64)), "log_score": pa.array(sums), "mean_log_score": pa.array(mean)})

    sent = dealt.groupBy("chunk").applyInArrow(send, BLOBS)
    answers = sent.groupBy("part").applyInArrow(totals, "chunk int, part int, totals binary")
    kind = docs.select(F.col(doc_id)).schema[0].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"doc_id {kind}, n_words long, log_score double, mean_log_score double")
