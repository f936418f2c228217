"""Quality by attention over passages (multiple-instance learning): only whole documents have labels.

Every passage of a text is encoded: shares of hashed byte n-grams and of kinds of characters and words, through one
learned layer. Gated attention (a tanh branch times a sigmoid branch) weighs the passages of a text, the weighted mean
of their codes is the text's representation, and a logistic layer scores it. All layers are learned together from
document labels on a bounded sample; scoring covers whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import SPACE

SAMPLE_ROWS = 6000  #: labelled rows that reach the driver for fitting, at most
SAMPLE_TEXT_BYTES = 1 << 15  #: longer texts are not learned from, so the sample has 200 MB at most; all are scored
PASSAGE = 40  #: words
BUCKETS = 192  #: of hashed n-grams
CODE, GATE = 24, 12  #: widths of a passage's code and of the attention's branches
EPOCHS, BAGS, RATE, DECAY = 40, 64, 0.004, 1e-4
THRESHOLD = 0.3
PIECE_BYTES = 1 << 20  #: passages of so much text are encoded at a time

KINDS = np.zeros(256, dtype=np.int64)  # of bytes: other, space, newline, lower, upper, digit, punctuation, beyond ASCII
for _i in range(256):
    _c = chr(_i)
    KINDS[_i] = 2 if _i == 10 else 1 if SPACE[_i] else 7 if _i > 127 else 3 if _c.islower() else 4 if _c.isupper() else 5 if _c.isdigit() else 6 if _i > 32 else 0
N_FEATURES = BUCKETS + 8 + 7


def passages(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text, begin and end of its words, and the first word of each passage and the end; a text without
    words is one empty passage."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8)
    inside = np.concatenate([[False], ~SPACE[data], [False]]).astype(np.int8)
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    n = max(-(-len(begin) // PASSAGE), 1)
    return data, begin, end, np.minimum(np.arange(n + 1) * PASSAGE, len(begin))


def encoded(text: str | None) -> np.ndarray:
    """One row of features for each passage of a text, computed by stretches of bounded length."""
    data, begin, end, first = passages(text)
    if not len(begin):
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    n, rows, at = len(first) - 1, [], 0
    start = begin[first[:-1]]
    while at < n:
        upto = max(at + 1, int(np.searchsorted(start, start[at] + PIECE_BYTES)))
        w = slice(first[at], first[upto])
        stop = start[upto] if upto < n else end[-1]
        rows.append(_features(data, int(stop), begin[w], end[w], first[at : upto + 1] - first[at]))
        at = upto
    return np.concatenate(rows)


def _features(data: np.ndarray, stop: int, begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Features of consecutive passages up to byte `stop`: n-gram shares, kinds of bytes, and how words repeat, end, and
    vary in length."""
    n = len(first) - 1
    a = begin[0]
    raw = data[a:stop]
    # bytes between passages count for the passage before
    passage = np.zeros(len(raw), dtype=np.int64)
    passage[begin[first[1:-1]] - a] = 1
    passage = np.cumsum(passage)
    size = np.bincount(passage, minlength=n).astype(np.float32)
    kinds = np.bincount(passage * 8 + KINDS[raw], minlength=n * 8).reshape(n, 8) / size[:, None]
    low = data[a : stop + 2].astype(np.uint32)  # n-grams that begin in the last passage may end beyond it
    pair = low[:-1] * np.uint32(257) + low[1:] * np.uint32(65537)
    three = pair[:-1] * np.uint32(31) + low[2:] * np.uint32(2654435761)
    grams = np.zeros(n * BUCKETS, dtype=np.float32)
    for code in (pair * np.uint32(2246822519), three * np.uint32(3266489917)):
        bucket = ((code >> np.uint32(16)) % np.uint32(BUCKETS)).astype(np.int64)
        m = min(len(code), len(raw))
        grams += np.bincount(passage[:m] * BUCKETS + bucket[:m], minlength=n * BUCKETS)
    words = np.diff(first).astype(np.float32)
    of = np.repeat(np.arange(n), np.diff(first))
    length = (end - begin).astype(np.float32)
    mean = np.bincount(of, length, n) / words
    spread = np.sqrt(np.maximum(np.bincount(of, length**2, n) / words - mean**2, 0))
    # a word's sum of weighted bytes tells it from others well enough to count repeats
    weighted = np.concatenate([[0], np.cumsum((low + 1.0) ** 1.5)])
    sums = np.round(weighted[end - a] - weighted[begin - a], 3)
    pairs = np.unique(np.column_stack([of, sums, length]), axis=0)
    distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n) / words
    again = np.concatenate([[False], (sums[1:] == sums[:-1]) & (length[1:] == length[:-1]) & (of[1:] == of[:-1])])
    last = KINDS[data[end - 1]] == 6
    single = length == 1
    other = [np.log1p(mean), np.log1p(spread), distinct, np.bincount(of, again, n) / words, np.bincount(of, last, n) / words, np.bincount(of, single, n) / words, np.log1p(words)]
    return np.column_stack([np.sqrt(grams.reshape(n, BUCKETS) / (2 * size[:, None])), kinds, *other]).astype(np.float32)


@dataclass
class Scorer:
    mean: np.ndarray
    spread: np.ndarray
    layers: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, start: np.ndarray) -> tuple:
        """Representation and logit of each bag of passage rows; start: the first row of each."""
        p = self.layers
        h = np.tanh((x - self.mean) / self.spread @ p["encode"] + p["encode0"])
        t = np.tanh(h @ p["tanh"] + p["tanh0"])
        g = 1 / (1 + np.exp(-(h @ p["gate"] + p["gate0"])))
        s = (t * g) @ p["attend"]
        count = np.diff(np.append(start, len(x)))
        a = np.exp(s - np.repeat(np.maximum.reduceat(s, start), count))
        a = a / np.repeat(np.add.reduceat(a, start), count)
        z = np.add.reduceat(a[:, None] * h, start)
        return h, t, g, a, count, z, z @ p["out"] + p["out0"]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        out = []
        for t in texts:
            out.append(self.bags(encoded(t), np.array([0]))[-1][0])
        return 1 / (1 + np.exp(-np.clip(np.array(out, dtype=np.float64), -30, 30)))


def _gradients(model: Scorer, x: np.ndarray, start: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss, by the chain rule through attention and encoder."""
    p = model.layers
    h, t, g, a, count, z, logit = model.bags(x, start)
    d = (1 / (1 + np.exp(-logit)) - y) / len(y)
    dz = np.repeat(d, count)[:, None] * p["out"]
    da = (dz * h).sum(axis=1)
    ds = a * (da - np.repeat(np.add.reduceat(a * da, start), count))
    dt, dg = (ds[:, None] * p["attend"] * g) * (1 - t**2), (ds[:, None] * p["attend"] * t) * g * (1 - g)
    dh = (a[:, None] * dz + dt @ p["tanh"].T + dg @ p["gate"].T) * (1 - h**2)
    u = (x - model.mean) / model.spread
    return {"encode": u.T @ dh, "encode0": dh.sum(0), "tanh": h.T @ dt, "tanh0": dt.sum(0), "gate": h.T @ dg, "gate0": dg.sum(0), "attend": (t * g).T @ ds, "out": z.T @ d, "out0": d.sum(keepdims=True)}


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit(rows: list[tuple[str | None, int]]) -> Scorer:
    """From (text, quality) rows. Without both labels the score is the share of good rows, one half for no rows at all.

    The layers of the epoch that a fifth of the rows, kept apart, likes best are taken.
    """
    draw = np.random.default_rng(0)
    rows = list({t or "": (t, y) for t, y in rows}.values())  # copies of a text would vote together
    y = np.array([k for _, k in rows], dtype=np.float32)
    shape = {"encode": (N_FEATURES, CODE), "encode0": CODE, "tanh": (CODE, GATE), "tanh0": GATE, "gate": (CODE, GATE), "gate0": GATE, "attend": GATE, "out": CODE, "out0": 1}
    p = {k: (draw.normal(0, s[0] ** -0.5, s) if isinstance(s, tuple) else draw.normal(0, 0.3, s) if k in ("attend", "out") else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    if not len(y) or y.min() == y.max():
        p["out"], p["out0"] = np.zeros(CODE, np.float32), np.array([0.0 if not len(y) else 30.0 if y[0] else -30.0], np.float32)
        return Scorer(np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32), p)
    bags = [encoded(t) for t, _ in rows]
    apart = np.zeros(len(y), dtype=bool)
    for k in (0, 1):
        apart[draw.permutation(np.flatnonzero(y == k))[::5]] = (y == k).sum() >= 5
    learn, judge = np.flatnonzero(~apart), np.flatnonzero(apart)
    judge = judge if len(judge) else learn
    every = np.concatenate([bags[i] for i in learn])
    model = Scorer(every.mean(0), every.std(0) + 0.02, p)
    stacked = lambda at: (np.concatenate([bags[i] for i in at]), np.concatenate([[0], np.cumsum([len(bags[i]) for i in at])[:-1]]), y[at])
    kept, best, step = p, np.inf, 0
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    xj, sj, yj = stacked(judge)
    for _ in range(EPOCHS):
        order = draw.permutation(learn)
        for i in range(0, len(order), BAGS):
            x, start, part = stacked(order[i : i + BAGS])
            step += 1
            grown = {}
            for k, g in _gradients(model, x, start, part).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                grown[k] = (model.layers[k] * (1 - RATE * DECAY) - RATE * move).astype(np.float32)
            model.layers = grown
        loss = _loss(model.bags(xj, sj)[-1], yj)
        if loss < best:
            kept, best = model.layers, loss
    model.layers = kept
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, text, quality) of labelled rows to learn from: crc32 of the id as text, modulo 5, is not 0.

    The `limit` ids that come first by hash are chosen from the labels alone, so that only their texts are moved. An id
    with several labels counts as bad if one says so; of several texts under an id one is taken. Null ids, labels other
    than 0 and 1, and texts beyond SAMPLE_TEXT_BYTES are left out; without labels there are no rows.
    """
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = F.broadcast(chosen.withColumnRenamed("doc_id", "marked_id"))  # `limit` rows of two numbers at most
    own = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_TEXT_BYTES)
    found = own.join(chosen, F.col("doc_id") == F.col("marked_id"))
    return found.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.max("quality").alias("quality"))


def learn(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Scorer:
    """A scorer from the sampled labelled rows, `limit` at most; nothing else reaches the driver. Reruns learn the same.

    Null and empty texts take part as one empty passage. Of an empty sample, or one with a single label, the scorer
    gives every text the same score (`fit`).
    """
    rows = training_rows(docs, labels, limit).collect()
    return fit([(r.text, r.quality) for r in sorted(rows, key=lambda r: r.doc_id)])


def score(docs: DataFrame, model: Scorer, text: str = "text", column: str = "quality_score") -> DataFrame:
    """`docs` with one more double column. Null and empty texts are scored as one empty passage.

    Rows, ties, repeated rows and other columns pass through unchanged; an own column named `column` is replaced.
    """
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    packed = docs.select(F.struct(*rest).alias("row"), F.col(text).cast("string").alias("said"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()), pa.float64())], names=["row", "score"])

    scored = packed.mapInArrow(run, packed.select("row").withColumn("score", F.lit(0.0)).schema)
    return scored.select("row.*", F.col("score").alias(column))


def classify(docs: DataFrame, model: Scorer, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    A null id is not held out. Repeated rows come back as often as they came, other columns are left out, and an empty
    table gives none.
    """
    s = score(docs.select("doc_id", "text"), model).drop("text")
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
