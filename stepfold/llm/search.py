"""Exact BM25 top-k by block-max pruning, without pivots, over sharded inverted indexes, merged under global statistics.

Each scan partition builds its shards: postings by term with term counts, documents ordered so that like ones share a
block. Document counts, lengths and document frequencies are summed over all shards before any score is computed, so
every shard scores as one index would. A query bounds each block by its terms' block maxima, scores the most promising
blocks first and skips all whose bound is below the k-th score so far. All queries of a batch that ask a block are scored
together: terms frequent in it by a product of matrices, the others by their postings. The query set goes round in
blocks of bounded size; only those and never documents pass through the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfold.llm.common import Words, cut

K = 10
K1, B = 1.2, 0.75
SHARD_DOCS = 8192
BLOCK_BITS = 9  #: 512 documents; smaller blocks bound tighter, but hold hardly more postings than entries
BLOCK = 1 << BLOCK_BITS
OFTEN = 64  #: postings in a block from which a term has a row in its matrix; about where a product of rows gets cheaper than sums of postings
BATCH, BATCH_TERMS = 512, 1 << 17  #: queries, and about at most their terms, that are scored at once
HASH_BYTES = 2 << 20
QUERY_BLOCK_TERMS = 500_000  #: (query, term) weights in a query block (8 MB), at most about; one block is live at a time
DIGITS = 6  #: scores are compared after rounding, so that equal texts tie and the smaller id wins

INDEX = "ids binary, lengths binary, terms binary, starts binary, docs binary, counts binary, n long, words long"


def term_rows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, text number, count) sorted by term and text, and the number of words of each text."""
    hashes, rows, lengths, at = [], [], [], 0
    while at < len(texts):
        size, upto = 0, at
        while upto < len(texts) and (upto == at or size < HASH_BYTES):
            size += len(texts[upto] or "")
            upto += 1
        w = Words([(t or "").lower() for t in texts[at:upto]])
        hashes.append(w.hashes())
        rows.append(np.repeat(np.arange(at, upto), w.count))
        lengths.append(w.count)
        at = upto
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.argsort(h, kind="stable")
    h, r = h[order], r[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])) if len(h) else np.empty(0, int)
    return np.rec.fromarrays([h[new], r[new], np.diff(np.append(new, len(h)))], names="term,doc,count"), np.concatenate(lengths)


def build_shard(ids: np.ndarray, texts: list[str | None]) -> dict:
    rows, lengths = term_rows(texts)
    # documents are numbered by their most frequent term, then length: texts of one kind share blocks
    best = np.lexsort((rows.term, -rows["count"], rows.doc))
    first = np.searchsorted(rows.doc[best], np.arange(len(ids)))
    head = np.zeros(len(ids), dtype=np.uint64)
    some = lengths > 0
    head[some] = rows.term[best][first[some]]
    number = np.empty(len(ids), dtype=np.int64)
    number[np.lexsort((lengths, head))] = np.arange(len(ids))
    doc = number[rows.doc]
    order = np.lexsort((doc, rows.term))
    terms, starts = np.unique(rows.term, return_index=True)
    new_ids, new_lengths = np.empty(len(ids), np.int64), np.empty(len(ids), np.int32)
    new_ids[number], new_lengths[number] = ids, lengths
    raw = {"ids": new_ids, "lengths": new_lengths, "terms": terms, "starts": starts.astype(np.int32), "docs": doc[order].astype(np.uint16), "counts": rows["count"][order].astype(np.uint32)}
    return {k: v.tobytes() for k, v in raw.items()} | {"n": len(ids), "words": int(lengths.sum())}


def build_index(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each shard of at most SHARD_DOCS documents of a scan partition; nothing is shuffled."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SHARD_DOCS):
                part = b.slice(at, SHARD_DOCS)
                yield pa.RecordBatch.from_pylist([build_shard(part.column(0).to_numpy(), part.column(1).to_pylist())], schema=kind)

    kind = pa.schema([(c, pa.binary()) for c in ("ids", "lengths", "terms", "starts", "docs", "counts")] + [("n", pa.int64()), ("words", pa.int64())])
    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, INDEX)


def document_frequencies(index: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for terms, starts, docs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                n = np.diff(np.append(np.frombuffer(starts, np.int32), len(docs) // 2))
                yield pa.RecordBatch.from_pydict({"term": np.frombuffer(terms, np.int64), "df": n.astype(np.int64)})

    return index.select("terms", "starts", "docs").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    def run(batches):
        for b in batches:
            rows, _ = term_rows(b.column(1).to_pylist())
            yield pa.RecordBatch.from_pydict({"query": b.column(0).take(pa.array(rows.doc)), "term": rows.term.view(np.int64), "count": rows["count"].astype(np.int64)})

    return queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "query long, term long, count long")


class Shard:
    """A shard ready to be searched: BM25 impacts, and for each (term, block) its postings and largest impact. A term that
    is frequent in a block has its impacts there as a row of the block's matrix, with a column for each document."""

    def __init__(self, row: dict, mean_length: float):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        docs = np.frombuffer(row["docs"], np.uint16)
        counts = np.frombuffer(row["counts"], np.uint32).astype(float)
        length = np.frombuffer(row["lengths"], np.int32) / max(mean_length, 1e-9)
        impact = counts * (K1 + 1) / (counts + (K1 * (1 - B + B * length))[docs])
        starts = np.frombuffer(row["starts"], np.int32).astype(np.int64)
        block = docs >> np.uint16(BLOCK_BITS)
        new = np.zeros(len(docs), dtype=bool)
        new[1:] = block[1:] != block[:-1]
        new[starts] = True
        begin = np.flatnonzero(new)
        self.block = block[begin]
        self.most = np.maximum.reduceat(impact, begin) if len(docs) else np.empty(0)
        self.first = np.append(np.searchsorted(begin, starts), len(begin))
        self.blocks = (len(self.ids) >> BLOCK_BITS) + 1
        # postings are laid out block by block, so that those of one block are near each other in memory
        order = np.argsort(block, kind="stable")
        self.place, self.impact = (docs[order] & np.uint16(BLOCK - 1)).astype(np.int64), impact[order]
        self.count = np.diff(np.append(begin, len(docs)))
        order = np.argsort(self.block, kind="stable")
        self.begin = np.empty(len(order), np.int64)
        self.begin[order] = np.cumsum(self.count[order]) - self.count[order]
        #: of a frequent (term, block), its row in the block's matrix; -1 of others
        self.row = np.full(len(self.block), -1)
        self.matrix = []
        often = np.flatnonzero(self.count >= OFTEN)
        for b in range(self.blocks):
            e = often[self.block[often] == b]
            self.row[e] = np.arange(len(e))
            at = self._spread(self.begin[e], self.count[e])
            self.matrix.append(np.zeros((len(e), BLOCK)))
            self.matrix[b][np.repeat(np.arange(len(e)), self.count[e]), self.place[at]] = self.impact[at]

    @staticmethod
    def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)

    def _scores(self, b: int, floor: np.ndarray, rare: tuple, often: tuple) -> tuple[np.ndarray, np.ndarray]:
        """The queries, numbered from 0 as their floors are, that may reach their floor in block b, and their scores of
        its documents, by (query, entry, weight) of rare and frequent terms. Sums of the rare ones sharpen the bound."""
        query, entry, w = rare
        many = self.count[entry]
        post = self._spread(self.begin[entry], many)
        spot, part = np.repeat(query * BLOCK, many), np.repeat(w, many)
        spot += self.place[post]
        part *= self.impact[post]
        score = np.bincount(spot, weights=part, minlength=len(floor) * BLOCK).reshape(len(floor), BLOCK)
        query, entry, w = often
        able = score.max(axis=1) + np.bincount(query, weights=self.most[entry] * w, minlength=len(floor)) >= floor
        number, use = np.cumsum(able) - 1, able[query]
        weights = np.zeros((number[-1] + 1, len(self.matrix[b])))
        weights[number[query[use]], self.row[entry[use]]] = w[use]
        total = weights @ self.matrix[b]
        total += score[able]
        return np.flatnonzero(able), total

    def search(self, query: np.ndarray, terms: np.ndarray, term: np.ndarray, weights: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores of all documents that may be among the k best of a query, of (query, number in `terms`,
        weight) rows; `terms` are sorted.

        `top` has a row for each query, with the k best scores so far; those of this shard are put in.
        """
        none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        own = (self.terms[at] == terms)[term]
        at, query, weights = at[term[own]], query[own], weights[own]
        many = self.first[at + 1] - self.first[at]
        entry, query, w = self._spread(self.first[at], many), np.repeat(query, many), np.repeat(weights, many)
        block = self.block[entry]
        bound = np.bincount(query * self.blocks + block, weights=self.most[entry] * w, minlength=len(top) * self.blocks).reshape(len(top), self.blocks)
        turn = np.argsort(np.argsort(-bound, axis=1, kind="stable"), axis=1)
        kind = 2 * block + (self.row[entry] >= 0)  # rare and frequent terms of a block one after the other
        order = np.argsort(kind, kind="stable")
        entry, query, w = entry[order], query[order], w[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(kind, minlength=2 * self.blocks))])
        k, found, done, wave = top.shape[1], [none], 0, 1
        while done < self.blocks:
            for b in range(self.blocks):
                ask = (turn[:, b] >= done) & (turn[:, b] < done + wave) & (bound[:, b] > 0) & (bound[:, b] >= top.min(axis=1) - 10.0**-DIGITS)
                asked = np.flatnonzero(ask)
                if not len(asked):
                    continue
                number, parts = np.cumsum(ask) - 1, []
                for here in (slice(ends[2 * b], ends[2 * b + 1]), slice(ends[2 * b + 1], ends[2 * b + 2])):
                    use = ask[query[here]]
                    parts.append((number[query[here][use]], entry[here][use], w[here][use]))
                able, score = self._scores(b, top[asked].min(axis=1) - 10.0**-DIGITS, *parts)
                asked = asked[able]
                if not len(asked):
                    continue
                better = np.flatnonzero(score.max(axis=1) > top[asked].min(axis=1))
                top[asked[better]] = np.partition(np.concatenate([top[asked[better]], score[better]], axis=1), -k, axis=1)[:, -k:]
                q, d = np.nonzero((score > 0) & (score >= top[asked].min(axis=1)[:, None] - 10.0**-DIGITS))
                found.append((asked[q], self.ids[d + (b << BLOCK_BITS)], score[q, d]))
            done, wave = done + wave, wave * 4
        query, ids, score = (np.concatenate(x) for x in zip(*found))
        last = score >= top.min(axis=1)[query] - 10.0**-DIGITS
        return query[last], ids[last], score[last]


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query."""
    order = np.lexsort((ids, -np.round(scores, DIGITS), query))
    query, ids, scores = query[order], ids[order], scores[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], scores[kept]


def batches_of(query: np.ndarray) -> list[slice]:
    """Rows of (query, term), sorted by query, in pieces of whole queries, each of a bounded number of queries and about of rows."""
    starts = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.empty(0, int)
    ends, pieces, at = np.append(starts[1:], len(query)), [], 0
    while at < len(starts):
        upto = max(at + 1, min(at + BATCH, int(np.searchsorted(ends, starts[at] + BATCH_TERMS, "right"))))
        pieces.append(slice(int(starts[at]), int(ends[upto - 1])))
        at = upto
    return pieces


def top_k(docs: DataFrame, queries: DataFrame, k: int = K, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score) of the k best documents of each query, of fewer where fewer share a term.

    Score: BM25 (k1 1.2, b 0.75, idf ln(1 + (N - df + .5) / (df + .5))), times the query's count of a term; words are
    lower-cased runs of anything but ASCII white space. Ties, after rounding to six digits, go to the smaller doc_id.
    Rows with a null id are left out on either side; null and empty texts match nothing but count in N. Repeated rows
    are different documents. Query ids are taken to be unique.
    """
    spark = docs.sparkSession
    index = cut(build_index(docs, doc_id, text))
    n, words = index.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = words / max(n, 1)
    df = document_frequencies(index)
    own = query_terms(queries, query_id, query_text)
    blocks = max(1, -(-own.count() // QUERY_BLOCK_TERMS))
    weight = F.col("count") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = cut(own.join(df, "term").select(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block"), "query", "term", weight.alias("w")))

    def search(batches, held):
        query, term, w = held.value
        pieces = []
        for rows in batches_of(query):
            names, number = np.unique(query[rows], return_inverse=True)
            none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            pieces.append([names, (number, *np.unique(term[rows], return_inverse=True), w[rows]), np.zeros((len(names), k)), none])
        for b in batches:
            for at in range(b.num_rows):
                shard = Shard(b.slice(at, 1).to_pylist()[0], mean)
                for piece in pieces:
                    _, asked, top, found = piece
                    piece[3] = best(*(np.concatenate(x) for x in zip(found, shard.search(*asked, top))), k)
        for names, *_, (q, i, s) in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "doc_id", "score"])

    results = None
    for block in range(blocks):
        rows = weighed.where(F.col("block") == block).select("query", "term", "w").toArrow()
        query, term, w = rows.column("query").to_numpy(), rows.column("term").to_numpy().view(np.uint64), rows.column("w").to_numpy()
        order = np.lexsort((term, query))
        query, term, w = query[order], term[order], w[order]
        held = spark.sparkContext.broadcast((query, term, w))
        found = cut(index.mapInArrow(lambda batches, held=held: search(batches, held), "query_id long, doc_id long, score double"))
        held.destroy()  # the block's results are in the shared folder
        results = found if results is None else results.union(found)
    rounded = results.withColumn("score", F.round("score", DIGITS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
